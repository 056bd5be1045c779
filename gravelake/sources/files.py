"""Reading and writing particle files through Spark's own file access, so that any store it reads will do."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from gravelake.params import parse_header, split_header
from gravelake.sources import codecs

Decoder = Callable[[bytes], dict[str, np.ndarray]]

#: Decoders by format name; ``register`` adds more.
FORMATS: dict[str, Decoder] = {name: (lambda content, name=name: codecs.fixed(content, name)) for name in codecs.RECORDS}
FORMATS |= {"pack9": lambda c: codecs.packed(c, 9), "pack14": lambda c: codecs.packed(c, 14), "rvint": codecs.rvint_columns, "heal1": lambda c: codecs.heal_columns(c, 1), "heal3": lambda c: codecs.heal_columns(c, 3)}
#: File patterns by format, for reading folders.
PATTERNS = {"pack9": "*.pack9*", "pack14": "*.dat", "rvint": "*rv*", "pid": "*pid*", "state": "position_*"}


def register(name: str, decoder: Decoder) -> None:
    FORMATS[name] = decoder


def _columns_of(decoder: Decoder, sample: dict[str, np.ndarray] | None) -> str:
    return ", ".join(f"{n} {'bigint' if v.dtype.kind in 'iu' else 'double'}" for n, v in sample.items())


def schema_of(name: str) -> str:
    """Columns of a format as a DDL string."""
    if name.startswith("pack"):
        return ", ".join(f"{c} double" for c in "x y z vx vy vz".split()) + (", pid bigint" if name == "pack14" else "")
    return _columns_of(FORMATS[name], FORMATS[name](b""))


def read(spark: SparkSession, path: str | list[str], format: str | Decoder, columns: list[str] | None = None, schema: str | None = None, pattern: str | None = None, header: bool = False, box: float | None = None, units: float | None = None, zspace: bool = False, share: float = 1.0, seed: int = 0) -> DataFrame:
    """Particles of one file, many files or a folder.

    ``format`` is a name or a function from bytes to columns (then give
    ``schema``).  ``header``: skip a text header.  ``units``/``box`` rescale
    positions; ``zspace`` shifts z by its velocity; ``share`` keeps a random part.
    One file is one row of Spark's binary source, decoded in one task.
    """
    decode = FORMATS[format] if isinstance(format, str) else format
    ddl = schema or schema_of(format)
    names = [part.split()[0] for part in ddl.split(",")]
    wanted = columns or names
    loader = spark.read.format("binaryFile")
    if pattern or (isinstance(format, str) and format in PATTERNS and isinstance(path, str) and not re.search(r"\.\w+$", path)):
        loader = loader.option("pathGlobFilter", pattern or PATTERNS[format])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                body = content[split_header(content)[1] :] if header else content
                got = decode(body)
                n = len(next(iter(got.values())))
                for at in range(0, n, 1 << 18) if n else ():
                    yield pd.DataFrame({c: got[c][at : at + (1 << 18)] for c in wanted} | {"file": file})

    kinds = dict(part.split() for part in ddl.split(","))
    out = loader.load(path).select("path", "content").mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in wanted) + ", file string")
    if zspace:
        out = out.withColumn("z", F.col("z") + F.col("vz"))
    if units is not None or box is not None:
        factor = (units or 1.0) / (box or 1.0)
        out = out.withColumns({c: F.col(c) * factor for c in "xyz" if c in wanted})
    return out.sample(share, seed) if share < 1 else out


def headers(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, value``: the text headers of files, one row for each entry."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                text = split_header(content)[0] or content.decode("utf-8", "replace")
                rows = [(file, k, str(v)) for k, v in parse_header(text).items()]
                yield pd.DataFrame(rows, columns=["path", "name", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, name string, value string")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``name, crc, size`` of every file, in the JVM."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.crc32("content").alias("crc"), F.col("length").alias("size"))


def by_slab(particles: DataFrame, path: str, cpd: int, box: float = 1.0, expected: int | None = None) -> int:
    """Write particles in folders by slab; the rows written are counted (and must be ``expected``) and returned."""
    from gravelake.functions.geometry import slab

    rows = particles.withColumn("slab", slab(F.col("x"), cpd, box))
    # A slab may be spread over many tasks: rows of a dense one are dealt by a hash as well.
    rows.repartition("slab", F.pmod(F.xxhash64("pid"), F.lit(8))).sortWithinPartitions("slab").write.mode("overwrite").partitionBy("slab").parquet(path)
    written = particles.sparkSession.read.parquet(path).count()
    if expected is not None and written != expected:
        raise RuntimeError(f"{written} of {expected} rows written to {path}")
    return written


class RecordFiles(DataSource):
    """A sink of binary record files: ``df.write.format("records").option("record", "rvdouble").save(folder)``.

    Each task writes one file into the folder, which all executors must share.
    """

    @classmethod
    def name(cls) -> str:
        return "records"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _RecordWriter(self.options)


#: Rows that a task encodes at once; packed records are in the order of cells inside a block.
_BLOCK = 1 << 16


class _Message(WriterCommitMessage):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows


class _RecordWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def write(self, iterator) -> _Message:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        folder, record = self.options["path"].removeprefix("file://"), self.options.get("record", "rvdouble")
        os.makedirs(folder, exist_ok=True)
        path, n = os.path.join(folder, f"part-{ctx.partitionId():05d}.{record}"), 0
        with open(f"{path}.{ctx.taskAttemptId()}", "wb") as f:
            for rows in iter(lambda: list(islice(iterator, _BLOCK)), []):
                columns = {c: np.array([r[c] for r in rows]) for c in rows[0].__fields__}
                if record in ("pack9", "pack14"):
                    f.write(codecs.encode_packed(columns, int(record[4:]), int(self.options["cpd"]), int(self.options.get("velocityscale", 1))))
                else:
                    f.write(codecs.encode_fixed(columns, record))
                n += len(rows)
        os.replace(f"{path}.{ctx.taskAttemptId()}", path)  # a second attempt replaces the first as a whole
        return _Message(path, n)

    def commit(self, messages) -> None:
        return None

    def abort(self, messages) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)
