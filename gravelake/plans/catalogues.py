"""Catalogue and initial-condition programs: conversion, re-slabbing, concatenation, consistency."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gravelake.functions import bits
from gravelake.functions.geometry import wrap_origin
from gravelake.operators.neighbours import in_box
from gravelake.operators.ordered import numbered
from gravelake.sources.files import by_slab
from gravelake.storage import stored

#: Rows of a task of ``transposed``.
ROWS = 1_000_000


def reindexed(halos: DataFrame, starts: dict[str, str], file: str = "file", order: str = "id") -> DataFrame:
    """Particle starts that count from each file's beginning made to count from the catalogue's.

    ``starts`` maps start columns to count columns.  Files are few: their totals
    are accumulated in one small window and joined back.
    """
    totals = halos.groupBy(file).agg(*[F.sum(n).alias(f"__{s}") for s, n in starts.items()])
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(file, *[F.coalesce(F.sum(f"__{s}").over(before), F.lit(0)).alias(f"__{s}") for s in starts])
    return halos.join(base, file).withColumns({s: F.col(s) + F.col(f"__{s}") for s in starts}).drop(*[f"__{s}" for s in starts])


def to_initial_conditions(particles: DataFrame, path: str, cpd: int, box_in: float, box_out: float, velocity_factor: float = 1.0, flip: bool = False, contiguous: bool = False) -> int:
    """Positions and velocities in new units, optionally mirrored, wrapped, with contiguous identifiers, written by slab."""
    sign = -1.0 if flip else 1.0
    scale = box_out / box_in
    out = particles.withColumns({c: wrap_origin(F.col(c) * (sign * scale) + box_out / 2, box_out) - box_out / 2 for c in "xyz"})
    out = out.withColumns({f"v{c}": F.col(f"v{c}") * (sign * velocity_factor) for c in "xyz"})
    if contiguous:
        out = out.withColumn("pid", bits.contiguous(F.col("pid")))
    return by_slab(out, path, cpd, box_out)


def zel_to_absolute(rows: DataFrame, ppd: int, box: float) -> DataFrame:
    """Displacements ``x, y, z`` of lattice sites ``i, j, k`` as positions, with identifiers from the sites."""
    placed = {c: wrap_origin(F.col(c) + F.col(n) * (box / ppd), box) - box / 2 for c, n in zip("xyz", "ijk", strict=True)}
    return rows.withColumns({**placed, "pid": bits.make_pid(F.col("i"), F.col("j"), F.col("k"))})


def transposed(particles: DataFrame, slab: str = "slab", name: str = "place") -> DataFrame:
    """The rows of every slab file numbered with the last lattice axis slowest (z, x, y); coordinates are untouched.

    Numbers run over all slabs in ranges of at most about ``ROWS`` rows, less
    what lies before a slab: no task sorts a whole slab.  Identifiers are unique.
    """
    axes = {f"__{a}": bits.lattice(F.col("pid"), a) for a in (2, 0, 1)}
    rows = stored(particles.withColumns(axes), "transposed")
    parts = max(int(particles.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / ROWS))
    placed = numbered(rows, [slab, *axes], name, parts)
    sizes = rows.groupBy(slab).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(slab).rowsBetween(Window.unboundedPreceding, -1)  # one row for each slab file
    starts = sizes.select(F.col(slab).alias("__slab"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), F.col(slab).eqNullSafe(F.col("__slab"))).select(*particles.columns, (F.col(name) - F.col("__start")).alias(name))


def merger_input(halos: DataFrame, particle_mass: float) -> DataFrame:
    """What matching needs of a catalogue: index, position, mass and tagged particles of both subsamples."""
    return halos.select("id", "n", *"xyz", (F.col("n") * particle_mass).alias("mass"), (F.col("ntagged_a") + F.col("ntagged_b")).alias("n_tagged"))


def printable(halos: DataFrame, least_size: int, least_mass: float, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Halos that a text catalogue lists: large and heavy enough, with their centre inside the bounds."""
    return in_box(halos.filter((F.col("size") >= least_size) & (F.col("mass") >= least_mass)), low, high)


def to_single_precision(df: DataFrame) -> DataFrame:
    """Every DOUBLE column as FLOAT."""
    return df.select(*[F.col(n).cast("float").alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def state_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row for each step from text state files, keys as columns."""
    from gravelake.sources.files import headers

    records = headers(spark, path)
    return records.groupBy("path").pivot("name").agg(F.first("value"))


def grouped_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``prefix, number, path, size`` of files whose names match two groups of ``pattern``, by prefix and number."""
    found = spark.read.format("binaryFile").load(path).select("path", "length")
    return found.select(F.regexp_extract("path", pattern, 1).alias("prefix"), F.regexp_extract("path", pattern, 2).cast("int").alias("number"), "path", F.col("length").alias("size")).filter("number is not null").orderBy("prefix", "number")


def light_cone_lookup(cone_halos: DataFrame, slice_halos: DataFrame, columns: list[str]) -> DataFrame:
    """Light-cone rows with columns of the time-slice halo that they were interpolated from."""
    kept = cone_halos.filter("interpolated_n > 0")
    return kept.join(slice_halos.select("index", *[F.col(c).alias(f"{c}_slice") for c in columns]), "index")


def unique_and_complete(particles: DataFrame, ppd: int) -> DataFrame:
    """One row: how many lattice identifiers are missing, repeated or foreign (all 0 in a sound set)."""
    want = particles.sparkSession.range(ppd**3).select(bits.make_pid(F.expr(f"id div {ppd * ppd}"), F.expr(f"id div {ppd}") % ppd, F.col("id") % ppd).alias("pid"), F.lit(1).alias("wanted"))
    have = particles.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    both = want.join(have, "pid", "full")
    return both.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("wanted").isNull()).alias("foreign"))
