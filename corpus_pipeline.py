"""A training corpus from raw documents, in five stages.

``STAGES`` are (name, function) pairs; each function takes (spark, docs,
sf_dir), works on all that its predecessor kept and returns a DataFrame, which
is written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelake.llm import exact_dedup, hilbert_packing, odd_sketch_dedup, pii, quality_rules
from gravelake.llm._store import finished, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their group's outlier test keep."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, at a similarity of 0.8."""
    return odd_sketch_dedup.keep_one(docs, percent=80, bands=32)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; ``n_chars`` follows the text."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, piece by piece, with their ids and a checksum of them."""
    pieces = hilbert_packing.pack_documents(docs)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("pii", private), ("packing", packed)]

#: Mahalanobis estimates, sketches, classifiers and tokens have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  What a stage stored is deleted when the next one's documents are written; the last two stages' tables stay, since the result reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (name, stage), (_, last) = STAGES
    with scratch(spark):
        for early, work in first:
            with scratch(spark):
                docs = finished(work(spark, docs, sf_dir), early.replace(" ", "-"))
        docs = finished(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)
