"""Packed positions and velocities.

Fixed values of the formats: a packed integer holds a position in steps of
1e-6 of the box (20 bits, signed) above 12 bits of velocity in 6000 km/s;
16-bit velocities are scaled to 32767.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITION_STEPS, POSITION_LIMIT, VELOCITY_FIELD = 1_000_000, 524_286, 4096
VELOCITY_SCALE, VELOCITY_HALF = 6000.0, 2048
SHORT = 32767


def pack_rvint(x: Column, v: Column) -> Column:
    """One packed integer of a position in the unit box and a velocity in km/s."""
    p = F.greatest(F.least(F.round(x * POSITION_STEPS), F.lit(float(POSITION_LIMIT))), F.lit(float(-POSITION_LIMIT))).cast("int")
    w = F.greatest(F.least(F.round((v / VELOCITY_SCALE + 1) * VELOCITY_HALF), F.lit(VELOCITY_FIELD - 1.0)), F.lit(0.0)).cast("int")
    return (p * VELOCITY_FIELD).bitwiseOR(w)


def unpack_rvint_velocity(packed: Column) -> Column:
    return (packed.bitwiseAND(F.lit(VELOCITY_FIELD - 1)) - VELOCITY_HALF) * (VELOCITY_SCALE / VELOCITY_HALF)


def unpack_rvint_position(packed: Column, box: float = 1.0) -> Column:
    cut = packed - packed.bitwiseAND(F.lit(VELOCITY_FIELD - 1))
    return cut / float(VELOCITY_FIELD) / float(POSITION_STEPS) * box


def pack_short_velocity(v: Column, scale: float) -> Column:
    """Truncated towards zero and shifted to an unsigned 16-bit range."""
    return F.greatest(F.least((v * (SHORT / scale)).cast("int") + SHORT, F.lit(2 * SHORT)), F.lit(0))


def unpack_short_velocity(packed: Column, scale: float) -> Column:
    return (packed - SHORT) * (scale / SHORT)


def quantise(w: Column, limit: float = 6000.0, bits: int = 13) -> Column:
    """Symmetric quantisation, halves to even, saturating at 16 bits."""
    step = (1 << bits) / (2 * limit)
    return F.greatest(F.least(F.bround(w * step), F.lit(32767.0)), F.lit(-32768.0)).cast("int")


def truncate_mantissa(w: Column, bits: int) -> Column:
    """Zero the lowest ``bits`` of a double's 52-bit mantissa, towards zero, by powers of two."""
    size = F.when(w == 0, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.abs(w))) - (52 - bits)))
    return F.signum(w) * F.floor(F.abs(w) / size) * size
