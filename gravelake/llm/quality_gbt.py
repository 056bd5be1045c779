"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each whole text gives one vector of statistics.  Labelled rows are taken in the
order of a hash of their id, at most ``MOST`` of them, to the driver, which
bins every statistic at quantiles and grows depth-limited trees on histograms
of gradients.  The trees are flattened into arrays (feature, threshold, left,
right, value) and traversed for all rows of a batch at once.

Inputs of a score are texts alone: never labels, lang, source or doc_id.

Defined results: null text counts as empty and is scored as such; a row's score
depends on its text alone, so repeated rows score alike; without labelled rows
every score is 0.5; other columns are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import materialise, text_columns
from ._words import as_binary, buffer_of, polynomial_hashes, slices, word_bounds

#: Labelled rows that a fit uses at most: 200,000 rows of 28 floats, 22 MB.
MOST = 200_000
TREES, DEPTH, RATE, BINS, LEAF, SHRINK = 120, 4, 0.1, 64, 20, 1.0
FEATURES = (
    "log_words", "mean_word", "sd_word", "long_words", "short_words", "lines", "words_a_line", "dup_lines", "symbols", "digits", "upper", "punctuation",
    "non_ascii", "spaces", "distinct_words", "repeat_next", "repeat_second", "repeat_pairs", "repeat_threes", "top_word", "entropy", "line_end_stop", "max_word", "odd_bytes", "caps_words", "digit_words", "tail_symbols", "empty",
)

_CLASS = {}
for _name, _bytes in (("symbols", b"#*$%&|<>{}[]=+_~^@\\/"), ("digits", b"0123456789"), ("upper", bytes(range(65, 91))), ("punctuation", b".,;:!?'\"()-"), ("non_ascii", bytes(range(128, 256))), ("spaces", b" \t\n\r\x0b\x0c"), ("odd_bytes", bytes([*range(0, 9), *range(14, 32), 127]))):
    _CLASS[_name] = np.zeros(256, bool)
    _CLASS[_name][list(_bytes)] = True


def _totals(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive edges."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.float64)])
    return sums[edges[1:]] - sums[edges[:-1]]


def _repeats(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of hashes: how many are distinct, the largest count, the entropy of the counts."""
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    first = np.ones(len(hs), bool)
    first[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(hs)))
    owner = rs[at]
    distinct = np.bincount(owner, minlength=n).astype(float)
    top = np.zeros(n)
    np.maximum.at(top, owner, count)
    return distinct, top, np.bincount(owner, count * np.log(count), n)


def document_features(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One vector of ``FEATURES`` for each row of a slice."""
    n = len(offs) - 1
    starts, ends, edge = word_bounds(raw, offs)
    sizes, words = (ends - starts).astype(float), np.diff(edge).astype(float)
    some, nbytes = np.maximum(words, 1), np.maximum(np.diff(offs), 1).astype(float)
    row = np.repeat(np.arange(n), np.diff(edge))
    h = polynomial_hashes(raw, starts, ends)
    out = dict.fromkeys(FEATURES, np.zeros(n))
    out["log_words"], out["empty"] = np.log1p(words), (words == 0).astype(float)
    out["mean_word"] = _totals(sizes, edge) / some
    out["sd_word"] = np.sqrt(np.maximum(_totals(sizes**2, edge) / some - out["mean_word"] ** 2, 0))
    out["long_words"], out["short_words"] = _totals(sizes > 12, edge) / some, _totals(sizes <= 3, edge) / some
    for name in ("symbols", "digits", "upper", "punctuation", "non_ascii", "spaces", "odd_bytes"):
        out[name] = _totals(_CLASS[name][raw], offs) / nbytes
    breaks = _totals(raw == 10, offs) + 1
    out["lines"], out["words_a_line"] = np.log1p(breaks), words / breaks
    if len(h):
        distinct, top, logs = _repeats(h, row, n)
        out["distinct_words"], out["top_word"] = distinct / some, top / some
        out["entropy"] = np.where(words > 1, np.log(some) - logs / some, 0)
        np.maximum.at(longest := np.zeros(n), row, sizes)
        out["max_word"] = np.log1p(longest)
        for name, gap in (("repeat_next", 1), ("repeat_second", 2)):
            same = np.zeros(len(h), bool)
            same[gap:] = (h[gap:] == h[:-gap]) & (row[gap:] == row[:-gap])
            out[name] = _totals(same, edge) / some
        for name, k in (("repeat_pairs", 2), ("repeat_threes", 3)):
            if len(h) >= k:
                inside = row[k - 1 :] == row[: len(row) - k + 1]
                mixed = h[: len(h) - k + 1].copy()
                for j in range(1, k):
                    mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
                if inside.any():
                    kinds, _, _ = _repeats(mixed[inside], row[: len(mixed)][inside], n)
                    runs = np.maximum(words - k + 1, 1)
                    out[name] = np.where(words >= k, 1 - kinds / runs, 0)
        last, lead = raw[ends - 1], raw[starts]
        out["line_end_stop"] = _totals(np.isin(last, list(b".!?:")), edge) / some
        out["caps_words"] = _totals(_CLASS["upper"][lead] & _CLASS["upper"][last], edge) / some
        out["digit_words"] = _totals(_CLASS["digits"][lead], edge) / some
        out["tail_symbols"] = _totals(_CLASS["symbols"][last], edge) / some
    line_start = np.flatnonzero(np.concatenate([[True], raw[:-1] == 10])) if len(raw) else np.zeros(0, np.int64)
    line_start = np.union1d(line_start, offs[:-1][np.diff(offs) > 0])
    if len(line_start):
        line_end = np.append(line_start[1:], len(raw))
        owner = np.searchsorted(offs, line_start, side="right") - 1
        kinds, _, _ = _repeats(polynomial_hashes(raw, line_start, line_end), owner, n)
        total = np.bincount(owner, minlength=n)
        out["dup_lines"] = np.where(total > 0, 1 - kinds / np.maximum(total, 1), 0)
    return np.stack([out[f] for f in FEATURES], 1).astype(np.float32)


@dataclass
class Forest:
    """Flattened trees: node arrays of all trees end to end, with the root of each."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row, all rows walking each tree together."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (inner := self.feature[node] >= 0).any():
                below = x[rows, np.maximum(self.feature[node], 0)] <= self.threshold[node]
                node = np.where(inner, np.where(below, self.left[node], self.right[node]), node)
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Gradient boosting of the logistic loss on binned features."""
    node_feature, node_threshold, node_left, node_right, node_value, roots = [], [], [], [], [], []
    n, p = x.shape
    rate = (y.sum() + 1) / (n + 2)
    start = float(np.log(rate / (1 - rate)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) if n else np.zeros(0, np.float32) for f in range(p)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1) if n else np.zeros((0, p), np.int64)
    total = np.full(n, start)
    flat = binned + np.arange(p) * BINS

    def leaf(value: float) -> int:
        for part, v in ((node_feature, -1), (node_threshold, 0.0), (node_left, -1), (node_right, -1), (node_value, value)):
            part.append(v)
        return len(node_feature) - 1

    def grow(rows: np.ndarray, level: int, g: np.ndarray, h: np.ndarray) -> int:
        sum_g, sum_h = g[rows].sum(), h[rows].sum()
        value = -RATE * sum_g / (sum_h + SHRINK)
        if level == 0 or len(rows) < 2 * LEAF:
            at = leaf(value)
            total[rows] += value
            return at
        where = flat[rows].ravel()
        hist = [np.bincount(where, np.repeat(w, p), p * BINS).reshape(p, BINS).cumsum(1)[:, :-1] for w in (g[rows], h[rows], np.ones(len(rows)))]
        gl, hl, nl = hist
        gain = gl**2 / (hl + SHRINK) + (sum_g - gl) ** 2 / (sum_h - hl + SHRINK) - sum_g**2 / (sum_h + SHRINK)
        gain[(nl < LEAF) | (len(rows) - nl < LEAF)] = 0
        f, b = np.unravel_index(gain.argmax(), gain.shape)
        if gain[f, b] <= 1e-6 or b >= len(cuts[f]):
            at = leaf(value)
            total[rows] += value
            return at
        at = leaf(0.0)
        below = binned[rows, f] <= b
        node_feature[at], node_threshold[at] = int(f), float(cuts[f][b])
        node_left[at] = grow(rows[below], level - 1, g, h)
        node_right[at] = grow(rows[~below], level - 1, g, h)
        return at

    for _ in range(trees if n else 0):
        prob = 1 / (1 + np.exp(-total))
        roots.append(grow(np.arange(n), depth, prob - y, prob * (1 - prob)))
    return Forest(np.array(node_feature, np.int64), np.array(node_threshold, np.float32), np.array(node_left, np.int64), np.array(node_right, np.int64), np.array(node_value), np.array(roots, np.int64), start if n else 0.0)


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, part in slices(as_binary(batch.column(1))):
            x = document_features(*buffer_of(part))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), flat], names=["doc_id", "features"])


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, features array<float>`` of every whole text."""
    rows = text_columns(docs, "doc_id", "text")
    return rows.mapInArrow(_features_of, T.StructType([rows.schema["doc_id"], T.StructField("features", T.ArrayType(T.FloatType()))]))


def held_out():
    """Rows that are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(rows: DataFrame, labels: DataFrame, target: str = "quality", most: int = MOST) -> Forest:
    """A forest from the labelled rows of ``features`` that are not held out."""
    wanted = text_columns(labels, "doc_id", target).filter(F.col(target).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(target).alias("y"))
    sample = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    got = rows.join(sample, "doc_id").select("doc_id", "features", F.col("y").cast("double").alias("y")).toArrow().combine_chunks()  # at most ``most`` labelled documents
    x = got["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, len(FEATURES))
    order = np.lexsort((*x.T, got["doc_id"].to_numpy()))  # tasks may answer in any order
    return fit_forest(x[order].astype(np.float32), got["y"].to_numpy()[order])


def classify(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = MOST) -> DataFrame:
    """``doc_id, held_out, score`` of every row."""
    rows = materialise(features(docs), "features")
    forest = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, target, most))  # at most TREES * 2**(DEPTH + 1) nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = forest.value
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", held_out().alias("held_out"), "score")


def crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def op5_quality_gbt(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
