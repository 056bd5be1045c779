"""Sky pixels: the nested HEALPix index of a direction, as expressions (Gorski et al. 2005)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _spread_bits(v: Column) -> Column:
    """Bits of a 32-bit number moved to the even places."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def nested_pixel(x: Column, y: Column, z: Column, nside: int) -> Column:
    """Nested pixel of the direction (x, y, z); ``nside`` must be a power of two.

    The direction is projected to the plane in which the twelve base pixels are
    squares on their corners: ``t`` and ``s`` count quarter turns along and half
    squares across the equator (s = 3 cos / 4 on the belt; beyond it the
    meridians of a quarter close in on the pole by ``q``).  Turned by an eighth,
    squares lie between whole numbers of ``east = t + s`` and ``west = t - s``
    (shifted by a half): those numbers name the base pixel, what is left of
    them the place inside it.
    """
    if nside & (nside - 1) or not 0 < nside <= 8192:
        raise ValueError("nside must be a power of two up to 8192")
    r = F.sqrt(x * x + y * y + z * z)
    cos = z / r
    turn = F.atan2(y, x) / (math.pi / 2)
    turn = F.when(turn < 0, turn + 4).otherwise(turn)
    turn = F.when(turn >= 4, F.lit(0.0)).otherwise(turn)
    middle = F.floor(turn) + 0.5
    belt = F.abs(cos) <= 2.0 / 3.0
    q = F.greatest(F.sqrt(x * x + y * y) / r * F.sqrt(3 / (1 + F.abs(cos))), F.lit(1e-12))
    t = F.when(belt, turn).otherwise(middle + q * (turn - middle))
    s = F.when(belt, cos * 0.75).otherwise(F.signum(cos) * (1 - q / 2))
    east, west = t + s + 0.5, t - s + 0.5
    i, j = F.floor(east), F.floor(west)
    face = F.when(i > j, F.pmod(j, F.lit(4))).when(i == j, F.pmod(i, F.lit(4)) + 4).otherwise(F.pmod(i, F.lit(4)) + 8)
    inside = lambda v, whole: F.least(F.floor((v - whole) * nside), F.lit(nside - 1))
    return face * (nside * nside) + _spread_bits(inside(east, i)) + F.shiftleft(_spread_bits(nside - 1 - inside(west, j)), 1)


def coarser(pix: Column, factor: int) -> Column:
    """The nested pixel, ``factor`` times wider, that holds ``pix``."""
    return F.shiftrightunsigned(pix, 2 * (factor.bit_length() - 1))
