"""Repeated passages by level-wise doubling of window lengths.

A passage counts as repeated when a window of ``window`` words has the same
word sequence as a window starting anywhere else.  Three lengths are looked at,
a quarter, a half and the whole of it, and only windows that repeat at one
length are extended to the next:

* level 1: of the short windows inside each long one, the one with the smallest
  hash is its anchor (equal long windows have equal anchors, so about one short
  window in fifteen stands for all).  Anchors whose words occur once are gone.
* level 2: the window of twice the length that begins or ends with the anchor,
  whichever lies inside the long window.
* level 3: the long windows over what is left.

Texts with equal word sequences are one class at all levels: one document
stands for it, and a class of two or more repeats as a whole.  A hash at any
level repeats when its smallest and its largest (document, position) differ, so
counting is two partial aggregates, however often a passage occurs.

Defined results: null and wordless texts have no words and nothing removed;
texts shorter than the window lose nothing; every row is a document of its own,
also where rows share a ``doc_id`` or have none, and repeated rows are separate
occurrences of the same passage; other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import ragged
from ._store import finished, materialise, scratch, text_columns
from ._words import as_binary, buffer_of, polynomial_hashes, sequence_keys, slices, window_hashes, word_bounds

WINDOW = 35


def lengths(window: int) -> tuple[int, int]:
    """Lengths of levels 1 and 2: half the next one, rounded up."""
    half = (window + 1) // 2
    return (half + 1) // 2, half


def _anchors(short: np.ndarray, span: int) -> np.ndarray:
    """For every run of ``span`` values the index of its smallest (the first of equals), by doubling."""
    n = len(short) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, size = np.arange(len(short)), 1
    while size < span:
        step = min(size, span - size)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(short[b] < short[a], b, a)
        size += step
    return best[:n]


def _rows_of(column: pa.Array):
    """Slices of a text column as word hashes with bounds: (first row, raw, starts, ends, hashes, edges)."""
    for at, part in slices(column):
        raw, offs = buffer_of(part)
        starts, ends, edge = word_bounds(raw, offs)
        yield at, len(part), raw, starts, ends, polynomial_hashes(raw, starts, ends), edge


def _long_begins(edge: np.ndarray, window: int) -> np.ndarray:
    """Word indices at which a long window fits into its row."""
    counts = np.maximum(np.diff(edge) - window + 1, 0)
    return ragged(edge[:-1], counts)


def _lists(offsets: np.ndarray, values: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(kind)))


def _first_pass(window: int):
    """Per row: id, key of the text, class key, number of words, digest of all words, and the anchors with their hashes."""
    short_k, _ = lengths(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = as_binary(batch.column(1))
            for at, n, raw, starts, ends, h, edge in _rows_of(column):
                whole = [hashlib.sha256(b" ".join(t.as_py().split())).hexdigest() for t in column.slice(at, n)]
                short = window_hashes(h, short_k).view(np.int64)
                spots = np.unique(_anchors(short, window - short_k + 1)[_long_begins(edge, window)]) if len(h) >= window else np.zeros(0, np.int64)
                row = np.searchsorted(edge, spots, side="right") - 1
                offsets = np.searchsorted(spots, edge)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), batch.column(2).slice(at, n), pa.array(sequence_keys(h, edge), pa.binary()), pa.array(np.diff(edge)), pa.array(whole), _lists(offsets, spots - edge[row], np.int32), _lists(offsets, short[spots], np.int64)],
                    names=["doc_id", "text_key", "seq", "n_words", "words_sha256", "place", "first"],
                )

    return run


def _candidates(batches: Iterator[pa.RecordBatch]):
    """Rows (class, text, seq, list) of candidates: (class, words' bounds and hashes, list), one at a time."""
    for batch in batches:
        classes, keys, lists = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
        for at, n, raw, starts, ends, h, edge in _rows_of(as_binary(batch.column(1))):
            own = sequence_keys(h, edge)
            for i in range(n):
                if own[i] == keys[at + i]:  # else another text with the same id and key
                    lo, hi = int(edge[i]), int(edge[i + 1])
                    yield classes[at + i], raw, starts[lo:hi], ends[lo:hi], h[lo:hi], np.sort(lists[at + i].values.to_numpy(zero_copy_only=False).astype(np.int64))


def _batched(rows, names: list[str], kinds: list[pa.DataType], most: int = 1 << 18):
    """Rows of (class, array, array) or (class, number, text) as record batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1]) + 1 if isinstance(row[1], np.ndarray) else len(row[2]) // 8 + 1
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _second_pass(window: int):
    """Half windows that begin (2 * place + 1) and end (2 * place) with the anchors that are left."""
    short_k, half_k = lengths(window)

    def rows(batches):
        for cls, _, _, _, h, places in _candidates(batches):
            half = window_hashes(h, half_k).view(np.int64)
            right = places[places < len(half)]
            left = places[places >= half_k - short_k]
            yield cls, np.concatenate([2 * right + 1, 2 * left]), np.concatenate([half[right], half[left - (half_k - short_k)]])

    return lambda batches: _batched(rows(batches), ["cls", "live", "half"], [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())])


def _third_pass(window: int):
    """Long windows whose half window is left."""
    short_k, half_k = lengths(window)

    def rows(batches):
        for cls, _, _, _, h, live in _candidates(batches):
            anchor = _anchors(window_hashes(h, short_k).view(np.int64), window - short_k + 1)
            begins_with = anchor - np.arange(len(anchor)) + half_k <= window
            begin = np.flatnonzero(np.isin(2 * anchor + begins_with, live))
            yield cls, begin, window_hashes(h, window).view(np.int64)[begin]

    return lambda batches: _batched(rows(batches), ["cls", "begin", "hash"], [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())])


def _cut(window: int):
    """What stays of each text when its repeated windows go."""

    def rows(batches):
        for cls, raw, starts, ends, h, begin in _candidates(batches):
            change = np.zeros(len(h) + 1, np.int64)
            np.add.at(change, begin, 1)
            np.add.at(change, begin + window, -1)
            stays = np.flatnonzero(np.cumsum(change[:-1]) == 0)
            words = [raw[a:b].tobytes() for a, b in zip(starts[stays].tolist(), ends[stays].tolist(), strict=True)]
            yield cls, len(h) - len(stays), b" ".join(words).decode("utf-8", "replace")

    return lambda batches: _batched(rows(batches), ["cls", "n_removed", "kept"], [pa.int64(), pa.int64(), pa.string()])


def _repeated(rows: DataFrame, key: str, place: str) -> DataFrame:
    """Hashes that occur at two different places, or in a class of several texts (those have negative numbers)."""
    code = F.xxhash64("cls", place)
    found = rows.groupBy(key).agg(F.min(code).alias("lo"), F.max(code).alias("hi"), F.min("cls").alias("least"))
    return found.filter("least < 0 or lo != hi").select(key)


def _passages(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The rows (``doc_id, seq, n_words, words_sha256``) and what their classes lose (``seq, several, n_removed, kept``)."""
    spark = docs.sparkSession
    source = text_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    rows = materialise(source.mapInArrow(_first_pass(window), "doc_id bigint, text_key bigint, seq binary, n_words bigint, words_sha256 string, place array<int>, first array<bigint>"), "anchors")
    # One text stands for a class; where the very row is repeated, that text is found several times.
    one = F.struct("doc_id", "text_key")
    grouped = rows.groupBy("seq").agg(F.min(one).alias("one"), (F.count(F.lit(1)) > 1).alias("several"), F.max("n_words").alias("n_words"))
    number = F.monotonically_increasing_id() + 1
    classes = materialise(grouped.select("seq", "several", "n_words", F.col("one.doc_id").alias("own"), F.col("one.text_key").alias("key"), F.when(F.col("several"), -number).otherwise(number).alias("cls")), "classes")

    def of_class(found: DataFrame, where: DataFrame) -> DataFrame:
        """Rows of ``where`` that stand for the classes in ``found``."""
        return where.join(found, (where["text_key"] == found["key"]) & where["doc_id"].eqNullSafe(found["own"]))

    with scratch(spark):
        # Level 1: anchors of one text of each class.
        ones = of_class(classes.select("own", "key", "cls", F.col("seq").alias("its")), rows.filter(F.size("place") > 0)).filter("seq = its")
        anchors = materialise(ones.select("cls", F.explode(F.arrays_zip("place", "first")).alias("x")).select("cls", "x.place", "x.first"), "level-1")
        once = materialise(_repeated(anchors, "first", "place"), "repeated-1")
        live = anchors.join(once, "first", "left_semi").groupBy("cls").agg(F.collect_set("place").alias("live"))
        found = finished(live.join(classes.select("cls", "own", "key", "seq"), "cls"), "live-1")
    # From here on only the texts that still have candidates are read.
    texts = materialise(of_class(found, source).select("cls", "text", "seq", "live"), "candidates")
    if texts.count() > found.count():  # rows repeated with id and text
        texts = materialise(texts.dropDuplicates(["cls"]), "candidates")
    with scratch(spark):
        halves = texts.mapInArrow(_second_pass(window), "cls bigint, live array<int>, half array<bigint>")
        halves = materialise(halves.select("cls", F.explode(F.arrays_zip("live", "half")).alias("x")).select("cls", "x.live", "x.half"), "level-2")
        two = materialise(_repeated(halves, "half", "live"), "repeated-2")
        live = finished(halves.join(two, "half", "left_semi").groupBy("cls").agg(F.collect_set("live").alias("live")), "live-2")
    with scratch(spark):
        spans = texts.select("cls", "text", "seq").join(live, "cls").mapInArrow(_third_pass(window), "cls bigint, begin array<int>, hash array<bigint>")
        spans = materialise(spans.select("cls", F.explode(F.arrays_zip("begin", "hash")).alias("x")).select("cls", "x.begin", "x.hash"), "level-3")
        three = materialise(_repeated(spans, "hash", "begin"), "repeated-3")
        begins = finished(spans.filter("cls > 0").join(three, "hash", "left_semi").groupBy("cls").agg(F.collect_set("begin").alias("begin")), "begins")
    cut = texts.filter("cls > 0").select("cls", "text", "seq").join(begins, "cls").mapInArrow(_cut(window), "cls bigint, n_removed bigint, kept string")
    partly = classes.select("cls", "seq").join(cut, "cls").select("seq", F.lit(False).alias("several"), "n_removed", "kept")
    wholly = classes.filter(F.col("several") & (F.col("n_words") >= window)).select("seq", "several", F.col("n_words").alias("n_removed"), F.lit("").alias("kept"))
    return rows.select("doc_id", "seq", "n_words", "words_sha256"), partly.unionByName(wholly)


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The rows (``doc_id, seq, n_words, words_sha256``) and what their classes lose (``seq, several, n_removed, kept``).

    Only classes that lose something are in the second table.  A class of
    several texts with at least ``window`` words loses all.
    """
    with scratch(docs.sparkSession):
        rows, cut = _passages(docs, window)
        return finished(rows, "passage-rows"), finished(cut, "passage-cuts")


def remove_repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``; the digest is of the kept words joined by single spaces."""
    with scratch(docs.sparkSession):
        rows, cut = _passages(docs, window)
        cut = materialise(cut.select("seq", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), "cut")
        return finished(
            rows.join(cut, "seq", "left").select(
                "doc_id",
                "n_words",
                F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
                F.coalesce("kept_sha256", "words_sha256").alias("kept_sha256"),
            ),
            "kept",
        )


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of repeated 35-word windows removed from all documents."""
    return remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT rid, list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i+34], ' '))) AS h FROM d WHERE len(w) >= 35),
s AS (SELECT rid, unnest(range(1, len(h) + 1)) AS i, unnest(h) AS h FROM k),
r AS (SELECT h FROM s GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT rid, list(DISTINCT p) AS g FROM (SELECT rid, unnest(range(i, i + 35)) AS p FROM s SEMI JOIN r USING (h)) GROUP BY 1),
flat AS (SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d SEMI JOIN gone USING (rid)),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS t FROM flat WHERE NOT EXISTS (SELECT 1 FROM (SELECT rid AS x, unnest(g) AS y FROM gone) z WHERE z.x = flat.rid AND z.y = flat.p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN g IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)
"""
