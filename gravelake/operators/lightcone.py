"""Light cones: which particles a shrinking sphere crosses during a step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crossings(particles: DataFrame, r_max: float, r_min: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Particles ``pid, x, y, z, wx, wy, wz`` (w: displacement in the step) at their crossing: adds ``frac, px, py, pz``.

    The cone's radius falls from ``r_max`` to ``r_min``; a particle is met at
    the share ``frac`` of the step at which both radii agree, kept for 0 <= frac < 1.
    """
    start = [F.col(c) - o for c, o in zip("xyz", origin, strict=True)]
    end = [s + F.col(f"w{c}") for s, c in zip(start, "xyz", strict=True)]
    r0 = F.sqrt(start[0] * start[0] + start[1] * start[1] + start[2] * start[2])
    r1 = F.sqrt(end[0] * end[0] + end[1] * end[1] + end[2] * end[2])
    radii = particles.drop("frac").withColumns({"__r0": r0, "__r1": r1})
    frac = (F.lit(r_max) - F.col("__r0")) / (F.lit(r_max) - F.lit(r_min) - F.col("__r0") + F.col("__r1"))
    # A filter on a plain column would move below it, with everything ``frac`` comes from written out at each
    # use: code too long for the JVM to compile.  It does not move below a generator, here of one row each.
    met = radii.select("*", F.inline(F.array(F.struct(frac.alias("frac"))))).drop("__r0", "__r1").filter("frac >= 0 and frac < 1")
    return met.withColumns({f"p{c}": F.col(c) + F.col(f"w{c}") * F.col("frac") for c in "xyz"})


def images(particles: DataFrame, repeats: int, box: float = 1.0) -> DataFrame:
    """Periodic copies from -repeats to repeats on every axis, with their numbers ``ix, iy, iz``."""
    every = F.sequence(F.lit(-repeats), F.lit(repeats))
    out = particles
    for c in "xyz":
        out = out.withColumn(f"i{c}", F.explode(every)).withColumn(c, F.col(c) + F.col(f"i{c}") * box)
    return out


def cells_in_shell(cells: DataFrame, cpd: int, r_max: float, r_min: float, tolerance: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Cells ``ci, cj, ck`` whose centres lie within ``tolerance`` of the shell: a filter on cells before their particles are read."""
    d = [(F.col(n) - (cpd - 1) / 2) / cpd - o for n, o in zip(("ci", "cj", "ck"), origin, strict=True)]
    d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    return cells.filter((d2 >= max(r_min - tolerance, 0) ** 2) & (d2 <= (r_max + tolerance) ** 2))


def whole_sky_steps(steps: DataFrame, box: float, repeats: int) -> DataFrame:
    """Steps whose shells lie inside the copied boxes."""
    return steps.filter(F.col("distance") <= box * (repeats + 0.5))
