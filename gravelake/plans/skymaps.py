"""Sky maps from sparse step maps: co-add, split, mean, coarsen, quantise, store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelake.functions.packing import quantise, truncate_mantissa
from gravelake.operators.maps import coadd, coarsen, dense
from gravelake.sources.files import read


def read_step_maps(spark: SparkSession, path: str, weights: int, first: int | None = None, last: int | None = None) -> DataFrame:
    """``step, pix, is_halo, n, w..`` of sparse map files below ``StepNNNN`` folders, for a range of steps."""
    names = ["n", *[f"w{i}" for i in range(weights)]]
    rows = read(spark, path, f"heal{weights}", pattern="*")
    step = F.regexp_extract("file", r"Step(\d+)", 1).cast("int")
    out = rows.select(step.alias("step"), "pix", (F.col("is_halo") == 1).alias("is_halo"), *names)
    if first is not None:
        out = out.filter(F.col("step") >= first)
    return out.filter(F.col("step") <= last) if last is not None else out


def shell_map(sparse: DataFrame, nside: int, weights: list[str], coarser_by: int = 1, halo: bool | None = None, quantised: tuple[str, ...] = (), truncate: int = 0) -> DataFrame:
    """A full map of counts and mean weights; only halo or field pixels with ``halo``."""
    rows = sparse if halo is None else sparse.filter(F.col("is_halo") == halo)
    full = dense(coadd(rows, weights), 12 * nside * nside, weights)
    if coarser_by > 1:
        full = coarsen(full, coarser_by, weights)
    for w in weights:
        if w in quantised:
            full = full.withColumn(w, quantise(F.col(w)))
        elif truncate:
            full = full.withColumn(w, truncate_mantissa(F.col(w), truncate))
    return full


def map_mean(full: DataFrame, weights: list[str]) -> DataFrame:
    """Means over all pixels, empty ones included."""
    return full.agg(F.count(F.lit(1)).alias("pixels"), F.avg("n").alias("n"), *[F.avg(w).alias(w) for w in weights])


def write_map(full: DataFrame, path: str, nside: int, weights: list[str], **notes: object) -> None:
    """The map sorted by pixel, and one row of its properties beside it."""
    full.repartitionByRange("pix").sortWithinPartitions("pix").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/map")
    about = map_mean(full, weights).withColumns({"nside": F.lit(nside), "order": F.lit("nested"), **{k: F.lit(v) for k, v in notes.items()}})
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
