"""MinHash near-duplicates with Odd Sketches as the candidates' filter.

1. Every document gets the set of its distinct word shingles (64-bit hashes),
   ``BANDS * ROWS`` MinHash samples, band keys, and an Odd Sketch: each sample
   toggles one of 512 bits, so the XOR of two sketches has the parity bits of
   the samples' symmetric difference, whose size its population count tells.
2. Equal sets are one node, for which one row stands.  In every band bucket two
   hubs, the most central member and one at random, get a candidate link to
   every member: linear in the bucket, whatever its size.
3. Sketches that are too far apart, and sizes that rule the similarity out,
   drop candidates; the others are confirmed on the full sets, first the best
   candidate of each node, then what still joins different components.
4. Buckets that still hold several components may have links that no hub
   shows (not those of two members, or of three with two hubs: their pairs all
   have a hub).  Up to ``SMALL`` members their sketches are compared.  Members of
   larger buckets are compared across components by a prefix filter: each set's
   shingles are ordered by how often they occur, those that
   one component has alone before all others, and two sets that are similar
   enough share one of the first ``n - ceil(s * n) + 1``, at places that leave
   enough room behind them.  Sizes, places and sketches are tested inside that
   join; sets are joined to what is left.  No bucket is capped.

A pair at the threshold shares no bucket with probability (1 - s**ROWS)**BANDS,
2e-8 at a similarity of 0.85, and is lost to the sketch with less than 1e-9.

Defined results: null and wordless texts have an empty set and are linked with
nothing; fewer words than a shingle make one shingle; every row is a document of
its own, also where rows share a doc_id or have none; a component is named by
its smallest id, and is null where none of its rows has one; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._graph import components
from ._store import finished, materialise, scratch, text_columns
from ._words import as_binary, buffer_of, mix, polynomial_hashes, slices, window_hashes, word_bounds

WORDS, BANDS, ROWS = 5, 24, 4
#: Bits of an Odd Sketch, kept as 64-bit integers.
SKETCH = 512
_BLOCK = 1024
#: Members up to which the pairs of a bucket are compared by sketch.
SMALL = 64
#: Rows (24 bytes each) up to which the documents whose sets are wanted are broadcast to the texts; beyond that both are shuffled.
MOST_WANTED = 1 << 18


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sorted distinct shingle hashes of each row, slice by slice, with the slice's first row."""
    for at, part in slices(column):
        raw, offs = buffer_of(part)
        starts, ends, edge = word_bounds(raw, offs)
        h = polynomial_hashes(raw, starts, ends, lower=True)
        windows = window_hashes(h, words)
        sets = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a >= words:
                sets.append(np.unique(windows[a : b - words + 1]))
            else:
                sets.append(window_hashes(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
        yield at, sets


def minhashes(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Smallest value of each permutation over a set (32 bits each)."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), _BLOCK):
        np.minimum(best, (factors[:, None] * low[None, at : at + _BLOCK]).min(1), out=best)
    return best


def _features(words: int, bands: int, rows: int, sketch: int):
    factors = np.random.default_rng(11).integers(0, 1 << 32, bands * rows, np.uint32) | np.uint32(1)
    index = np.arange(bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in shingle_sets(as_binary(batch.column(1)), words):
                n = len(sets)
                sampled = np.zeros((n, bands * rows), np.uint64)
                nodes = [b""] * n
                for i, s in enumerate(sets):
                    if len(s):
                        sampled[i] = minhashes(s, factors)
                        nodes[i] = xxhash.xxh3_128_digest(s.tobytes())
                values = mix(sampled ^ (index << np.uint64(32)))
                keys = np.zeros((n, bands), np.uint64)
                for r in range(rows):
                    keys = keys * np.uint64(0x9E3779B97F4A7C15) + values[:, r::rows]
                keys = mix(keys ^ np.arange(bands, dtype=np.uint64))
                bits = np.zeros((n, sketch), np.uint8)
                np.bitwise_xor.at(bits, (np.arange(n)[:, None], (values >> np.uint64(20)) % np.uint64(sketch)), 1)
                packed = np.packbits(bits, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n),
                        batch.column(2).slice(at, n),
                        pa.array(nodes, pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel())),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * packed.shape[1]), pa.array(packed.ravel())),
                    ],
                    names=["doc_id", "text_key", "node", "n", "bands", "sketch"],
                )

    return run


def _far(sketch: int, samples: int, percent: int) -> int:
    """Differing sketch bits that a pair at the threshold passes with probability below 1e-9."""
    off = 1 - percent / 100
    differing = 2 * (samples * off + 6.5 * (samples * off * (1 - off)) ** 0.5)
    mean = sketch / 2 * (1 - np.exp(-2 * differing / sketch))
    return int(min(sketch, mean + 4 * (mean * (1 - mean / sketch)) ** 0.5 / 2 + 6))


def _apart(a: str, b: str, longs: int) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(longs)), F.lit(0))


def _text_key() -> Column:
    """What tells rows with one id apart, for finding their texts again."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _labelled(docs: DataFrame, words: int, percent: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, text_key, n, component`` of every row."""
    source = text_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key().alias("text_key"))
    longs = SKETCH // 64
    far = _far(SKETCH, bands * rows, percent)
    sketched = source.mapInArrow(_features(words, bands, rows, SKETCH), "doc_id bigint, text_key bigint, node binary, n bigint, bands array<bigint>, sketch array<bigint>")
    features = materialise(sketched.withColumn("id", F.monotonically_increasing_id()), "sketches")
    filled = features.filter("n > 0")
    # Equal sets: one representative each.  The row number in the key spreads a hot set's rows.
    nodes = materialise(filled.groupBy("node").agg(F.min("id").alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("members")), "nodes")
    reps = materialise(filled.join(nodes.select("node", F.col("rep").alias("id")), ["node", "id"], "left_semi").select("id", "doc_id", "text_key", "n", "bands", "sketch"), "reps")
    buckets = reps.select("id", F.explode("bands").alias("bucket"))
    sizes = materialise(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "bucket-sizes")
    shared = materialise(buckets.join(sizes, "bucket"), "shared")
    # Central documents have their samples in common with many others.
    central = materialise(shared.groupBy("id").agg(F.sum(F.floor(F.log2("size"))).alias("centre")), "central")
    shared = materialise(shared.join(central, "id").select("id", "bucket", "centre"), "shared")
    order = F.col("id").bitwiseXOR(F.col("bucket"))
    hubs = materialise(shared.groupBy("bucket").agg(F.max(F.struct("centre", F.bitwise_not("id").alias("x"))).alias("top"), F.min(order).alias("lo"), F.count(F.lit(1)).alias("size")).select("bucket", F.bitwise_not("top.x").alias("h1"), F.col("lo").bitwiseXOR(F.col("bucket")).alias("h2"), "size"), "hubs")
    stars = shared.join(hubs, "bucket").select("id", F.explode(F.array("h1", "h2")).alias("hub")).filter("id != hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    sketches = reps.select("id", "n", "sketch")

    def side(name: str) -> DataFrame:
        return sketches.withColumnsRenamed({"id": name, "n": f"n{name}", "sketch": f"s{name}"})

    similar_size = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    candidates = materialise(
        materialise(stars, "stars").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", _apart("sa", "sb", longs).alias("apart")).filter(similar_size & (F.col("apart") <= far)),
        "candidates",
    )

    # Full sets of the documents that share a bucket with another.
    needed = materialise(reps.select("id", "doc_id", "text_key").join(shared.select("id").distinct(), "id", "left_semi"), "needed")

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in shingle_sets(as_binary(batch.column(1)), words):
                offs = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.view(np.int64)))], names=["id", "shingles"])

    wanted = needed.withColumnRenamed("doc_id", "own")
    texts = source.join(F.broadcast(wanted) if needed.count() <= MOST_WANTED else wanted, (source["text_key"] == wanted["text_key"]) & source["doc_id"].eqNullSafe(F.col("own"))).select("id", "text")
    sets = materialise(texts.mapInArrow(full_sets, "id bigint, shingles array<bigint>"), "sets")
    if sets.count() > needed.count():  # rows repeated with id and text
        sets = materialise(sets.dropDuplicates(["id"]), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        joined = pairs.select("a", "b").join(sets.withColumnsRenamed({"id": "a", "shingles": "xa"}), "a").join(sets.withColumnsRenamed({"id": "b", "shingles": "xb"}), "b")
        both = F.size(F.array_intersect("xa", "xb"))
        return joined.filter(100 * both >= percent * (F.size("xa") + F.size("xb") - both)).select("a", "b")

    best = candidates.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    best = best.union(candidates.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")).distinct()
    tried = materialise(best, "best")
    labels = components(materialise(confirmed(tried), "links"))

    def crossing(pairs: DataFrame, at: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components so far."""
        own = at.select(F.col("node"), F.col("label"))
        return (
            pairs.join(own.withColumnsRenamed({"node": "a", "label": "la"}), "a", "left")
            .join(own.withColumnsRenamed({"node": "b", "label": "lb"}), "b", "left")
            .filter(~F.coalesce(F.col("la") == F.col("lb"), F.lit(False)))
        )

    rest = materialise(crossing(candidates.select("a", "b").join(tried, ["a", "b"], "left_anti"), labels).select("a", "b"), "rest")
    labels = components(materialise(confirmed(rest), "links"), labels)

    # Buckets with several components: what hubs did not show.
    within = materialise(shared.select("id", "bucket").distinct().join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", "bucket", F.coalesce("label", F.xxhash64("id")).alias("label")), "within")

    mixed = within.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("bucket")
    unseen = hubs.filter("size > 3 or size = 3 and h1 = h2").select("bucket", "size")
    open_buckets = materialise(mixed.join(unseen, "bucket"), "open-buckets")
    inside = materialise(within.join(open_buckets, "bucket").join(reps.select("id", "n", "sketch"), "id"), "inside")
    sides = [inside.filter(F.col("size") <= SMALL).withColumnsRenamed({"id": x, "label": f"l{x}", "n": f"n{x}", "sketch": f"s{x}"}).drop("size") for x in "ab"]
    close = similar_size & (F.col("la") < F.col("lb")) & (_apart("sa", "sb", longs) <= far)
    in_small = sides[0].join(sides[1], (sides[0]["bucket"] == sides[1]["bucket"]) & close).select("a", "b")
    members = materialise(inside.filter(F.col("size") > SMALL).select("id", "label", "n", "sketch").dropDuplicates(["id"]), "members")
    flat = materialise(sets.join(members.select("id", "label"), "id").select("id", "label", F.explode("shingles").alias("shingle")), "member-shingles")
    common = flat.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y")
    met = flat.select("id", "shingle").join(materialise(common.select("shingle", "often"), "common-shingles"), "shingle")
    own = Window.partitionBy("id")
    # What one component has alone comes first; it is counted without being ranked.
    ranked = materialise(met, "met").withColumns({"rank": F.row_number().over(own.orderBy("often", "shingle")), "all": F.count(F.lit(1)).over(own)})
    placed = ranked.join(members, "id").withColumn("place", F.col("rank") + F.col("n") - F.col("all"))
    prefixes = materialise(placed.filter(f"place <= n - ({percent} * n + 99) div 100 + 1").select("id", "label", "n", "shingle", "place", "sketch"), "prefixes")
    left = prefixes.withColumnsRenamed({"id": "a", "label": "la", "n": "na", "place": "pa", "sketch": "sa"})
    right = prefixes.withColumnsRenamed({"id": "b", "label": "lb", "n": "nb", "place": "pb", "sketch": "sb"})
    room = F.expr(f"1 + least(na - pa, nb - pb) >= ({percent} * (na + nb) + {99 + percent}) div {100 + percent}")
    in_large = left.join(right, (left["shingle"] == right["shingle"]) & close & room).select("a", "b")
    across = materialise(in_small.union(in_large).distinct(), "across")
    labels = components(materialise(confirmed(across), "links"), labels)

    # Every node's component, then every row's.
    known = nodes.select(F.col("rep").alias("node"), "least")
    smallest = materialise(labels.join(known, "node").groupBy("label").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("linked")), "smallest")
    of_node = materialise(labels.join(smallest, "label").select(F.col("node").alias("rep"), "component", "linked"), "of-node")
    several = nodes.join(of_node, "rep", "left").filter("linked > 1 or members > 1").select("node", F.when(F.col("linked") > 1, F.col("component")).otherwise(F.col("least")).alias("component"), F.lit(True).alias("several"))
    placed = features.join(materialise(several, "several"), "node", "left")
    return placed.select("doc_id", "text_key", "n", F.when(F.col("several"), F.col("component")).otherwise(F.col("doc_id")).alias("component"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id``: components of links with ``100 * intersection >= percent * union``."""
    with scratch(docs.sparkSession):
        found = _labelled(docs, words, percent, bands, rows)
        return finished(found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")), "near-duplicates")


def op2_odd_sketch_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = 85, bands: int = BANDS) -> DataFrame:
    """The input's rows, all columns, without those whose component is named by another id; components without any id stay whole."""
    with scratch(docs.sparkSession):
        found = _labelled(docs, WORDS, percent, bands, ROWS).filter("not (doc_id <=> component)")
        drop = finished(found.select(F.col("doc_id").alias("__gl_id"), F.col("text_key").alias("__gl_key")).distinct(), "dropped")
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("__gl_id"))
    return docs.join(drop, (_text_key() == F.col("__gl_key")) & own, "left_anti").select(*docs.columns)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r(node, label) AS (SELECT a, a FROM edge UNION SELECT e.b, r.label FROM r JOIN edge e ON e.a = r.node),
c AS (SELECT node, min(label) AS label FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.label, w.doc_id) AS component_id, coalesce(c.label, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = w.doc_id
"""
