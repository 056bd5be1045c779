"""Token counts by a map-side two-tier lookup.

Tier one is a compact hash table, made once and broadcast: 64-bit hashes and
token counts of the ``hot`` most frequent pre-token chunks of the whole corpus.
Map tasks count their chunks and encode the ``SUMMARY`` most frequent ones; only
(hash, length, count) of those leave a task, 20 bytes each, so pre-tokens are
never shuffled or gathered.  Tier two is each worker's own bounded table; what
it lacks is encoded there and then.

Defined results: null text counts as empty (0 bytes, 0 tokens); rows are
independent, so repeated rows and ids give repeated results; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _bpe
from ._store import text_columns
from ._words import as_binary, buffer_of, polynomial_hashes, slices

VOCABULARY = "byte_bpe_50k.json"
#: Entries of the broadcast table: 10 bytes each, so 640 KiB at most.
HOT = 1 << 16
#: Chunks that one task reports, and that it keeps between slices.
SUMMARY, KEPT = 4096, 1 << 16
#: Longer chunks are not worth a place in the table.
LONGEST = 64


def read_vocabulary(path: str | None) -> bytes:
    """The vocabulary file's content; it is broadcast, so that only the driver needs the file."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return f.read()


def frequent_lengths(docs: DataFrame, vocab, hot: int = HOT) -> DataFrame:
    """``hash, length``: the most frequent chunks over all texts and their numbers of tokens, from summaries of every task."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bpe.ChunkTable(_bpe.vocabulary(vocab.value), limit=2)
        hashes, counts, chunks = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)
        for batch in batches:
            for _, part in slices(as_binary(batch.column(0))):
                raw, offs = buffer_of(part)
                if not len(raw):
                    continue
                starts = table.cuts(raw, offs)
                ends = np.append(starts[1:], len(raw))
                short = ends - starts <= LONGEST
                starts, ends = starts[short], ends[short]
                h, first, n = np.unique(polynomial_hashes(raw, starts, ends), return_index=True, return_counts=True)
                if len(h) > KEPT:
                    top = np.argpartition(-n, KEPT)[:KEPT]
                    h, first, n = h[top], first[top], n[top]
                blob = raw.tobytes()
                own = np.empty(len(h), object)
                own[:] = [blob[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                hashes, at, back = np.unique(np.concatenate([hashes, h]), return_index=True, return_inverse=True)
                chunks = np.concatenate([chunks, own])[at]
                counts = np.bincount(back, np.concatenate([counts, n])).astype(np.int64)
                if len(hashes) > KEPT:
                    top = np.sort(np.argpartition(-counts, KEPT)[:KEPT])
                    hashes, counts, chunks = hashes[top], counts[top], chunks[top]
        top = np.argsort(-counts, kind="stable")[:SUMMARY]
        lengths = _bpe.ChunkTable(table.vocab, limit=SUMMARY).lengths(list(chunks[top]))
        yield pa.RecordBatch.from_arrays([pa.array(hashes[top].view(np.int64)), pa.array(lengths, pa.int32()), pa.array(counts[top], pa.int64())], names=["hash", "length", "n"])

    parts = text_columns(docs, "text").mapInArrow(summarise, "hash bigint, length int, n bigint")
    return parts.groupBy("hash").agg(F.max("length").alias("length"), F.sum("n").alias("n")).orderBy(F.desc("n"), "hash").limit(hot).select("hash", "length")


def token_counts(docs: DataFrame, path: str | None = None, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text; ``path``: a byte-level BPE ``tokenizer.json``."""
    sc, content = docs.sparkSession.sparkContext, read_vocabulary(path)
    vocab = sc.broadcast(content)
    top = frequent_lengths(docs, vocab, hot).toArrow()  # at most ``hot`` rows of 12 bytes
    lengths = sc.broadcast((top["hash"].to_numpy().view(np.uint64), top["length"].to_numpy().astype(np.uint16)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _bpe.worker_table(vocab.value, hot=lengths.value)
        for batch in batches:
            for at, part in slices(as_binary(batch.column(1))):
                raw, offs = buffer_of(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(np.diff(offs)), pa.array(worker.counts(raw, offs))], names=["doc_id", "n_bytes", "n_tokens"])

    rows = text_columns(docs, "doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(count, schema)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents, and whether they pass 512 tokens."""
    counts = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)
