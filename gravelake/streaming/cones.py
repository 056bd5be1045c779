"""Light cones and event windows as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gravelake.functions.healpix import nested_pixel


def step_stream(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 8) -> DataFrame:
    """Particle files as they arrive; the batch bound is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def first_crossings(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each (cone, particle, image) once: a particle met again in the next step is dropped.

    The stream has ``ts, lc, pid, image``; the watermark bounds the state.
    """
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["lc", "pid", "image"])


def shell_maps(stream: DataFrame, nside: int) -> DataFrame:
    """Sparse pixel maps by step of a stream of crossings ``step, px, py, pz, w``."""
    pix = nested_pixel(F.col("px"), F.col("py"), F.col("pz"), nside)
    return stream.groupBy("step", pix.alias("pix")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w0"))


def write_by_step(stream: DataFrame, path: str, checkpoint: str, also: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append every batch below ``step=`` folders; a repeated batch replaces its own part."""

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step", "batch").parquet(path)
        if also:
            also(df, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling or sliding windows of event time, for late data up to ``delay``."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def event_sessions(events: DataFrame, gap: str = "2 hours", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
