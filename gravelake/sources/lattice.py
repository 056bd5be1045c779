"""Generated particles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelake.functions.bits import make_pid


def lattice(spark: SparkSession, ppd: int, velocity: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """``ppd**3`` particles on a cubic lattice, ``x = i / ppd - 0.5``, with one velocity."""
    n = spark.range(ppd**3)
    i, j, k = F.expr(f"id div {ppd * ppd}"), F.expr(f"id div {ppd}") % ppd, F.col("id") % ppd
    place = lambda c, name: (c / ppd - 0.5).alias(name)
    return n.select(make_pid(i, j, k).alias("pid"), place(i, "x"), place(j, "y"), place(k, "z"), *[F.lit(float(v)).alias(f"v{c}") for c, v in zip("xyz", velocity, strict=True)])


def plane_wave(spark: SparkSession, ppd: int, amplitude: float, modes: int = 1) -> DataFrame:
    """A lattice displaced along x by a sine of ``modes`` waves, with the velocity of its growing mode (in the same units)."""
    p = lattice(spark, ppd)
    shift = amplitude * F.sin(F.col("x") * (2 * math.pi * modes))
    return p.withColumns({"vx": shift, "x": F.col("x") + shift})
