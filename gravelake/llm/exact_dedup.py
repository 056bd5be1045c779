"""Exact deduplication with a persistent digest index.

The index is a Parquet table bucketed and sorted by the texts' SHA-256.  A
batch is reduced to one row for each digest, sort-merge anti-joined with the
index (whose buckets need no shuffle), and what is new is appended.  Copies
inside a batch: the row with the largest ``doc_id`` stays.  Copies of texts
that the index already has: the indexed document stays.

A batch may be ingested again, for instance where the job after it failed: a
row is kept where its id is the one that the index has for its text, so a
second run keeps the same rows and appends nothing.  (Rows with a null id can't
be told apart: they count as the indexed one where that has no id either.)

Defined results: null text counts as empty; a null ``doc_id`` loses to any
other, and a group of null ids alone keeps null; rows with equal text and equal
largest id are all marked as the one that stays, and ``keep_first`` leaves one
of them; other columns pass through ``keep_first`` and are ignored elsewhere;
an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import finished, materialise, new_path, scratch, text_columns

#: Buckets of a new index.  Fixed for the index's life; 4096 suits some 10**11 digests.
BUCKETS = 64


def digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def group_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, keep_id, group_size`` of every row of one batch.

    Groups are counted by partial aggregates; only groups of two or more are
    joined back, between plain scans, so that a hot digest's rows can be split.
    """
    rows = materialise(text_columns(docs, "doc_id", "text").select("doc_id", digest(F.col("text")).alias("digest")), "digests")
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    several = materialise(groups.filter("group_size > 1"), "digest-groups")
    return rows.join(several, "digest", "left").select(
        "doc_id",
        "digest",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
    )


class DigestIndex:
    """Digests seen so far: a table at ``path``, opened again by path in later sessions."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, groups: DataFrame) -> DataFrame:
        """Append the digests of a grouped batch (``group_copies``) that the index lacks; they are returned."""
        fresh = (
            groups.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
            .select("digest", "keep_id")
            .distinct()
            .join(self.table().hint("merge"), "digest", "left_anti")
        )
        new = materialise(fresh, "new-digests")  # before the write, since the same table is read
        new.repartition(self.buckets, "digest").write.insertInto(self.name)
        return new

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Deduplicate a batch against itself and the index, and append what is new.

        Returns ``doc_id, keep_id, group_size, kept, text_sha256`` of every row;
        ``keep_id`` may be a document of an earlier batch.
        """
        groups = materialise(group_copies(docs), "grouped")
        new = self.add(groups)
        known = groups.select("digest").distinct().join(new.select("digest"), "digest", "left_anti")
        earlier = self.table().hint("merge").join(known, "digest", "left_semi")
        earlier = materialise(earlier.select("digest", F.struct("keep_id").alias("indexed")), "known-digests")
        keep_id = F.when(F.col("indexed").isNull(), F.col("keep_id")).otherwise(F.col("indexed.keep_id"))
        return groups.join(earlier, "digest", "left").select(
            "doc_id",
            keep_id.alias("keep_id"),
            "group_size",
            F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def exact_dedup(docs: DataFrame, index_path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``ingest`` of one batch into the index at ``index_path``, or into a new one."""
    spark = docs.sparkSession
    return DigestIndex(spark, index_path or new_path(spark, "digest-index"), buckets).ingest(docs)


def keep_first(docs: DataFrame, index_path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The input's rows, with all their columns, one for each text that the index lacked."""
    spark = docs.sparkSession
    lowest = F.lit(-(1 << 63))
    with scratch(spark):
        found = exact_dedup(docs, index_path, buckets)
        stay = finished(found.filter("kept").select(F.coalesce("doc_id", lowest).alias("__gl_id"), F.unhex("text_sha256").alias("__gl_digest")), "staying")
    marked = docs.withColumns({"__gl_id": F.coalesce("doc_id", lowest), "__gl_digest": digest(F.col("text"))})
    # The id is part of the key, so the many rows of a hot digest go to many tasks.
    return marked.join(stay, ["__gl_id", "__gl_digest"], "left_semi").dropDuplicates(["__gl_id", "__gl_digest"]).select(*docs.columns)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents against a new index."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
