"""Sequence packing along a space-filling curve.

Hashed document vectors are projected to ``DIMS`` dimensions and ordered by
their Hilbert key; documents are range-sorted by (key, doc_id) and cut into
sequences of ``capacity`` tokens in that order, so neighbours on the curve
share sequences.  Each range partition packs on its own: sequences carry the
partition in their high bits, and a partition's last, short run is cut at
powers of two, so that nothing is padded at all.

Defined results: null text counts as empty (its end id alone); equal keys
follow ``doc_id``, so a large group of copies is spread over partitions; rows
are independent, so repeated rows give repeated pieces; an empty table gives
none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _bpe
from ._store import materialise, text_columns
from ._words import as_binary, buffer_of, slices
from .token_counts import read_vocabulary

CAPACITY, END_ID = 2048, 1
#: Dimensions and bits a dimension of the curve; buckets of the hashed vectors; range that coordinates are cut to.
DIMS, BITS, BUCKETS, RANGE = 4, 12, 4096, 0.25


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n, dims), by Skilling's transpose method."""
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    q = np.uint64(1) << np.uint64(bits - 1)
    while q > 1:
        p = q - np.uint64(1)
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= np.uint64(1)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1) << np.uint64(bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - np.uint64(1)), t)
        q >>= np.uint64(1)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << np.uint64(1) | (x[i] >> np.uint64(b) & np.uint64(1))
    return key.astype(np.int64)


def document_keys(ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Hilbert key of each row's ids; no row may be empty."""
    signs = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (DIMS, BUCKETS))
    bucket = (ids.astype(np.int64) * 2654435761 >> 7) % BUCKETS
    n = np.diff(offs)
    cells = np.empty((len(n), DIMS), np.int64)
    for d in range(DIMS):
        mean = np.add.reduceat(signs[d][bucket], offs[:-1], dtype=np.float64) / n
        cells[:, d] = np.clip((mean + RANGE) / (2 * RANGE) * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_keys(cells, BITS)


def _squeeze(ids: np.ndarray) -> bytes:
    """Ids as byte planes, compressed."""
    return pa.compress(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _restore(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``; ``ids``: the piece's tokens as little-endian uint32."""
    vocab = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _bpe.worker_table(vocab.value)
        for batch in batches:
            for at, part in slices(as_binary(batch.column(1))):
                ids, offs = worker.ids(*buffer_of(part))
                ids = np.insert(ids, offs[1:], np.uint32(end_id))
                offs = offs + np.arange(len(offs))
                edges = offs.tolist()
                blobs = [_squeeze(ids[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(document_keys(ids, offs)), pa.array(np.diff(offs)), pa.array(blobs, pa.binary())], names=["doc_id", "key", "doc_tokens", "ids"])

    rows = text_columns(docs, "doc_id", "text")
    id_field = rows.schema["doc_id"]
    schema = T.StructType([id_field, T.StructField("key", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    # Written once: the range sort samples its input first, which would tokenise everything twice.
    tokens = materialise(rows.mapInArrow(tokenise, schema), "packing-tokens")
    along = tokens.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        ctx = TaskContext.get()
        base = (ctx.partitionId() if ctx else 0) << 40
        sequence = filled = 0
        tail: list[tuple] = []  # pieces of the sequence that is not full yet
        id_type = None

        def out(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True)) if pieces else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:6]), pa.array(columns[6], pa.binary())], names=names)

        ready: list[tuple] = []
        size = 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, total, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                raw = _restore(blob.as_py(), total).tobytes()
                start = 0
                while start < total:
                    length = min(total - start, capacity - filled)
                    tail.append((doc, start, length, total, base + sequence, filled, raw[4 * start : 4 * (start + length)]))
                    start, filled = start + length, filled + length
                    if filled == capacity:
                        ready += tail
                        size += 4 * capacity
                        tail, sequence, filled = [], sequence + 1, 0
                        if size > 4 << 20:
                            yield out(ready)
                            ready, size = [], 0
        # The rest in sequences whose lengths are powers of two.
        room, at = (1 << filled.bit_length() - 1) if filled else 0, 0
        for doc, start, length, total, _, _, raw in tail:
            done = 0
            while done < length:
                n = min(length - done, room - at)
                ready.append((doc, start + done, n, total, base + sequence, at, raw[4 * done : 4 * (done + n)]))
                done, at, filled = done + n, at + n, filled - n
                if at == room:
                    room, at, sequence = (1 << filled.bit_length() - 1) if filled else 0, 0, sequence + 1
        if ready:
            yield out(ready)

    longs = [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    return along.mapInArrow(pack, T.StructType([id_field, *longs, T.StructField("ids", T.BinaryType())]))


def op8_hilbert_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens; pieces with a checksum of their ids."""
    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
