"""Tables written between stages: below the checkpoint folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local master may leave it unset and gets a temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="gravelake-"))
    return f"file://{_LOCAL[0]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: cut lineage that outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrowed(totals: DataFrame, column: str, name: str) -> DataFrame:
    """``totals``, stored, with its whole decimals ``column`` as LONG if all of them fit, else as DECIMAL(38, 0)."""
    kept = stored(totals.withColumn(column, F.col(column).cast("decimal(38,0)")), name)
    wide = kept.filter(~F.col(column).between(F.lit(-(1 << 63)), F.lit((1 << 63) - 1)))
    return kept.withColumn(column, F.col(column).cast("long")) if wide.isEmpty() else kept
