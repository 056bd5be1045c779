"""Time steps of particles: kick, statistics, drift, cells again; every step a stored table."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelake.functions.geometry import cell, wrap_origin
from gravelake.operators.neighbours import near_force


def kick(particles: DataFrame, factor: float) -> DataFrame:
    return particles.withColumns({f"v{c}": F.col(f"v{c}") + F.col(f"a{c}") * factor for c in "xyz"})


def drift(particles: DataFrame, factor: float, cpd: int) -> DataFrame:
    """Positions moved and wrapped, and the cells they are in now."""
    moved = particles.withColumns({c: wrap_origin(F.col(c) + F.col(f"v{c}") * factor + 0.5, 1.0) - 0.5 for c in "xyz"})
    return moved.withColumns({n: cell(F.col(c), cpd) for n, c in (("slab", "x"), ("cj", "y"), ("ck", "z"))})


def cell_table(particles: DataFrame) -> DataFrame:
    """Counts and extremes of every cell."""
    v2 = F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2
    return particles.groupBy("slab", "cj", "ck").agg(
        F.count(F.lit(1)).alias("count"), F.avg(v2).alias("mean_square_velocity"), F.max(F.greatest(*[F.abs(f"v{c}") for c in "xyz"])).alias("max_component_velocity"), F.max(F.greatest(*[F.abs(f"a{c}") for c in "xyz"])).alias("max_component_acceleration")
    )


def state_row(cells: DataFrame, cpd: int) -> DataFrame:
    """One row for the step from its cells."""
    n = F.sum("count")
    ratio = F.sqrt("mean_square_velocity") / F.when(F.col("max_component_acceleration") > 0, F.col("max_component_acceleration"))
    return cells.agg(n.alias("np"), F.min("count").alias("min_cell"), F.max("count").alias("max_cell"), F.max("max_component_velocity").alias("max_velocity"), F.max("max_component_acceleration").alias("max_acceleration"), F.min(ratio).alias("min_vrms_on_amax"), F.sqrt(F.sum(F.col("mean_square_velocity") * F.col("count")) / n).alias("rms_velocity"), F.sqrt(F.sum(F.col("count") * F.col("count")) * float(cpd**3) / (n * n) - 1).alias("sigma_delta"))


def choose_step(a: float, limits: dict[str, float]) -> tuple[float, str]:
    """The smallest of the limits on the step in a (relative step, distance to an output, drift, kick), and its name."""
    name = min(limits, key=limits.get)
    if limits[name] <= 0:
        raise ValueError(f"no step left at a = {a}: {name}")
    return limits[name], name


def near_only(radius: float, eps: float) -> Callable[[DataFrame], DataFrame]:
    """Accelerations from near neighbours alone."""
    return lambda p: p.drop("ax", "ay", "az").join(near_force(p, p, radius, eps), "pid")


def total_acceleration(near: DataFrame, far: DataFrame, omega_m: float, omega_smooth: float, total: int) -> DataFrame:
    """Near and far parts ``pid, ax, ay, az`` added and put into the units of the step: times 3 (omega_m - omega_smooth) / (8 pi total).

    Both parts are sums over sources of (sink - source) / r**3, hence the sign.
    """
    factor = -3 * (omega_m - omega_smooth) / (8 * math.pi * total)
    both = near.join(far.withColumnsRenamed({f"a{c}": f"f{c}" for c in "xyz"}), "pid")
    return both.select("pid", *[((F.col(f"a{c}") + F.col(f"f{c}")) * factor).alias(f"a{c}") for c in "xyz"])


def slab_windows(rows: DataFrame, cpd: int, radius: int, slab: str = "slab", name: str = "centre") -> DataFrame:
    """Every row once for each slab whose window of ``radius`` slabs to both sides holds it (periodic); group by ``name`` to act on a window."""
    if 2 * radius + 1 > cpd:
        raise ValueError(f"a window of {2 * radius + 1} slabs is wider than the box of {cpd}")
    shifts = F.array(*[F.lit(o) for o in range(-radius, radius + 1)])
    return rows.withColumn("__o", F.explode(shifts)).withColumn(name, F.pmod(F.col(slab) + F.col("__o"), F.lit(cpd))).drop("__o")


def lpt_displacement(first: DataFrame, second: DataFrame, growth1: float, growth2: float) -> DataFrame:
    """Second-order displacements combined with their growth factors; both ``pid, dx, dy, dz``."""
    return first.join(second.withColumnsRenamed({f"d{c}": f"e{c}" for c in "xyz"}), "pid").select("pid", *[(growth1 * F.col(f"d{c}") + growth2 * F.col(f"e{c}")).alias(f"d{c}") for c in "xyz"])


def steps_done(spark: SparkSession, path: str) -> int:
    """Steps whose state row was written; it is written last, so it marks success."""
    try:
        return spark.read.parquet(f"{path}/state").agg(F.max("step")).first()[0] + 1
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "does not exist" in str(error):
            return 0
        raise


def run_steps(particles: DataFrame, path: str, cpd: int, factors: list[tuple[float, float]], forces: Callable[[DataFrame], DataFrame], furthest: int = 1) -> DataFrame:
    """Run the steps that ``path`` lacks and return the state log.

    ``factors``: kick and drift of each step.  A particle that crosses more
    than ``furthest`` slabs in a step is late: the step stops, with those
    particles in ``path/late``.  The particle count must not change.
    """
    spark = particles.sparkSession
    done = steps_done(spark, path)
    for step in range(done, len(factors)):
        now = spark.read.parquet(f"{path}/particles/step={step - 1}") if step else particles
        kick_by, drift_by = factors[step]
        forced = forces(now)
        moved = kick(forced, kick_by).withColumn("from", cell(F.col("x"), cpd))
        moved = drift(moved, drift_by, cpd)
        away = F.pmod(F.col("slab") - F.col("from"), F.lit(cpd))
        moved = moved.withColumn("away", F.least(away, F.lit(cpd) - away))
        here = f"{path}/particles/step={step}"
        moved.drop("from").write.mode("overwrite").parquet(here)
        after = spark.read.parquet(here)
        late = after.filter(F.col("away") > furthest)
        if not late.isEmpty():
            late.write.mode("overwrite").parquet(f"{path}/late")
            raise RuntimeError(f"particles crossed more than {furthest} slabs in step {step}; they are in {path}/late")
        state = state_row(cell_table(after), cpd).withColumn("step", F.lit(step))
        if state.first()["np"] != now.count():
            raise RuntimeError(f"step {step} lost particles")
        state.coalesce(1).write.mode("append").parquet(f"{path}/state")
    return spark.read.parquet(f"{path}/state").orderBy("step")
