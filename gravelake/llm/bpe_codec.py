"""BPE encoding and decoding of whole texts.

The merge loop is a segment tree over the ranks of adjacent pairs (``_bpe``):
its root yields the leftmost pair of lowest rank, and each merge updates three
leaves in logarithmic time until no mergeable pair is left.

Defined results: null text counts as empty (no ids, empty text); special
strings inside texts become their ids, as the vocabulary file says; rows are
independent; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _bpe
from ._store import text_columns
from ._words import as_binary, buffer_of, slices
from .token_counts import read_vocabulary


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text."""
    vocab = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _bpe.worker_table(vocab.value)
        for batch in batches:
            for at, part in slices(as_binary(batch.column(1))):
                ids, offs = worker.ids(*buffer_of(part))
                lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), lists], names=["doc_id", "ids"])

    rows = text_columns(docs, "doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""
    vocab = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _bpe.vocabulary(vocab.value)
        for batch in batches:
            texts = [v.decode(np.array(row.as_py() or [], np.int64)) for row in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = text_columns(encoded, "doc_id", "ids")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())]))


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode, decode the ids again, and keep digests of both: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    The same coder as ``encode`` and ``decode``, without moving ids and texts out of the worker.
    """
    vocab = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _bpe.worker_table(vocab.value)
        v = worker.vocab
        for batch in batches:
            for at, part in slices(as_binary(batch.column(1))):
                ids, offs = worker.ids(*buffer_of(part))
                edges = offs.tolist()
                rows = [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(part)),
                        pa.array(np.diff(offs)),
                        pa.array([hashlib.sha256(v.decimal_bytes(r)).hexdigest() for r in rows]),
                        pa.array([hashlib.sha256(v.decode(r).encode()).hexdigest() for r in rows]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = text_columns(docs, "doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return rows.mapInArrow(run, schema)


def op3_bpe_codec(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded text of all documents, as digests."""
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
