"""Particle identifiers and the packed auxiliary word, as expressions on LONG columns.

Fixed values of the data format: a particle id holds three 15-bit lattice
coordinates at bits 0, 16 and 32; flags lie at the bits named below; a 10-bit
compressed density begins at bit 49; light-cone flags begin at bit 61.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD = 0x7FFF
SHIFTS = (0, 16, 32)
PID_MASK = 0x7FFF7FFF7FFF
TAGGED_PID_MASK = 0x07FF7FFF7FFF7FFF
FLAGS = {"L0": 15, "L1": 31, "L1_sticky": 47, "tagged": 48, "taggable_A": 59, "taggable_B": 60}
DENSITY_SHIFT, DENSITY_BITS = 49, 10
LIGHT_CONE_SHIFT, LIGHT_CONES = 61, 3


def _long(c: Column) -> Column:
    return c.cast("long")


def pid(aux: Column) -> Column:
    """The identifier bits of an auxiliary word."""
    return aux.bitwiseAND(F.lit(PID_MASK))


def lattice(pid: Column, axis: int) -> Column:
    """Lattice coordinate 0, 1 or 2 of an identifier."""
    return F.shiftrightunsigned(pid, SHIFTS[axis]).bitwiseAND(F.lit(FIELD))


def make_pid(x: Column, y: Column, z: Column) -> Column:
    return _long(x).bitwiseOR(F.shiftleft(_long(y), SHIFTS[1])).bitwiseOR(F.shiftleft(_long(z), SHIFTS[2]))


def spread(linear: Column) -> Column:
    """A contiguous 45-bit identifier laid out in three fields."""
    parts = [F.shiftleft(F.shiftrightunsigned(_long(linear), 15 * i).bitwiseAND(F.lit(FIELD)), SHIFTS[i]) for i in range(3)]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2])


def contiguous(pid: Column) -> Column:
    """The inverse of ``spread``."""
    parts = [F.shiftleft(lattice(pid, i), 15 * i) for i in range(3)]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2])


def linear_site(pid: Column, ppd: int) -> Column:
    """Row-major number of the lattice site."""
    return (lattice(pid, 0) * ppd + lattice(pid, 1)) * ppd + lattice(pid, 2)


def _mask(bit: int) -> int:
    """A single bit of a signed 64-bit word."""
    return -(1 << 63) if bit == 63 else 1 << bit


def test_flag(aux: Column, name: str) -> Column:
    return F.shiftrightunsigned(aux, FLAGS[name]).bitwiseAND(F.lit(1)) == 1


def set_flag(aux: Column, name: str) -> Column:
    return aux.bitwiseOR(F.lit(_mask(FLAGS[name])))


def clear_flag(aux: Column, name: str) -> Column:
    return aux.bitwiseAND(F.lit(~_mask(FLAGS[name])))


def in_light_cone(aux: Column, cone: int) -> Column:
    """Whether the particle was already output on cone 0, 1 or 2."""
    return F.shiftrightunsigned(aux, LIGHT_CONE_SHIFT + cone).bitwiseAND(F.lit(1)) == 1


def set_light_cone(aux: Column, cone: int) -> Column:
    return aux.bitwiseOR(F.lit(_mask(LIGHT_CONE_SHIFT + cone)))


def clear_light_cones(aux: Column) -> Column:
    return aux.bitwiseAND(F.lit((1 << LIGHT_CONE_SHIFT) - 1))


def pack_density(aux: Column, density: Column, unit: float) -> Column:
    """Store the rounded square root of the density in units of ``unit``; it must stay below 1023."""
    value = _long(F.round(F.sqrt(F.abs(density) / unit)))
    field = ((1 << DENSITY_BITS) - 1) << DENSITY_SHIFT
    return aux.bitwiseAND(F.lit(~field)).bitwiseOR(F.shiftleft(F.least(value, F.lit(1023)), DENSITY_SHIFT))


def unpack_density(aux: Column, unit: float) -> Column:
    root = F.shiftrightunsigned(aux, DENSITY_SHIFT).bitwiseAND(F.lit((1 << DENSITY_BITS) - 1)).cast("double")
    return root * root * unit


def taggable_field(particles: DataFrame, aux: str = "aux") -> DataFrame:
    """Particles of either taggable subsample that are in no large-scale group."""
    flags = F.col(aux)
    return particles.filter((test_flag(flags, "taggable_A") | test_flag(flags, "taggable_B")) & ~test_flag(flags, "L0"))


def swap_bytes(word: Column, size: int) -> Column:
    """The bytes of a word of 4 (as an unsigned number) or 8 bytes in the other order."""
    if size not in (4, 8):
        raise ValueError("words have 4 or 8 bytes")
    digits = F.lpad(F.hex(word.cast("long") if size == 8 else word.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 2 * size, "0")
    turned = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])
    # Halves, since a number of 64 bits need not fit a signed one.
    high, low = (F.conv(F.substring(F.lpad(turned, 16, "0"), at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)
