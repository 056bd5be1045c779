"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder.  Only a local master may leave it
unset (tests, a single machine); a process-wide temporary folder is used then.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: Tables that each open ``scratch`` will delete, the innermost last.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())
#: Rows and bytes that one batch of whole texts may hold, in the reader and on the way to Python workers.
BOUNDS = {"spark.sql.parquet.columnarReaderBatchSize": 512, "spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="gravelake-"))
    return f"file://{_LOCAL[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives later joins plain
    scans below their exchanges, which adaptive execution can split when a
    key is skewed.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if opened := _SCRATCH.get():
        opened[-1].append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes inside are deleted at the end; what is to outlive them goes through ``finished``."""
    made: list[str] = []
    token = _SCRATCH.set((*_SCRATCH.get(), made))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in made:
            delete(spark, path)


def finished(df: DataFrame, name: str) -> DataFrame:
    """``materialise`` for the result of a ``scratch``, which leaves it to the enclosing one, if any."""
    own, opened = materialise(df, name), _SCRATCH.get()
    if opened:
        path = opened[-1].pop()
        if len(opened) > 1:
            opened[-2].append(path)
    return own


def bound_batches(spark: SparkSession) -> None:
    """Lower this session's batch sizes to ``BOUNDS``: whole texts are long, and a batch of thousands is many times a task's share of memory."""
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in BOUNDS.items():
        now = spark.conf.get(key)
        if not 0 < (as_bytes(now) if now[-1].isalpha() else int(now)) <= most:
            spark.conf.set(key, str(most))


def text_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, with missing ones reported by name; from here on this session's batches are bounded."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"input lacks columns {missing}; it has {df.columns}")
    bound_batches(df.sparkSession)
    return df.select(*names)
