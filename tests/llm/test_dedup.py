"""Exact and near deduplication against brute force."""

import hashlib
from collections import defaultdict

import pytest

from gravelake.llm import exact_dedup, odd_sketch_dedup
from gravelake.llm._store import new_path

from .conftest import SCHEMA, odd_rows


def test_exact(odd):
    groups = defaultdict(list)
    for r in odd_rows():
        groups[r[1] or ""].append(r[0])
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(odd).collect()}
    assert len(got) == len(odd_rows())
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
            assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_index_outlives_batches(spark, odd):
    path = new_path(spark, "index")
    first, second = odd.filter("doc_id % 2 = 0"), odd.filter("doc_id % 2 = 1")
    seen = {}
    for batch in (first, second, odd):
        rows = exact_dedup.exact_dedup(batch, path).collect()
        own = defaultdict(list)
        for r in rows:
            own[r.text_sha256].append(r.doc_id)
        for r in rows:
            assert r.keep_id == seen.get(r.text_sha256, max(own[r.text_sha256]))
            assert r.kept == (r.doc_id == r.keep_id)  # the indexed document itself stays, however often it comes
        for d, ids in own.items():
            seen.setdefault(d, max(ids))
    index = exact_dedup.DigestIndex(spark, path)
    assert index.table().count() == len(seen)
    plan = index.table().join(index.table().withColumnRenamed("keep_id", "k"), "digest")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan  # buckets are used


def test_batch_twice(spark, odd):
    path = new_path(spark, "index")
    first = sorted(exact_dedup.exact_dedup(odd, path).collect())
    size = exact_dedup.DigestIndex(spark, path).table().count()
    assert sorted(exact_dedup.exact_dedup(odd, path).collect()) == first
    assert exact_dedup.DigestIndex(spark, path).table().count() == size
    kept = sorted(r.doc_id for r in exact_dedup.keep_first(odd, path).collect())
    assert kept == sorted(r.doc_id for r in first if r.kept)


def test_old_and_new_in_one_batch(spark):
    path = new_path(spark, "index")
    schema = "doc_id long, text string"
    exact_dedup.exact_dedup(spark.createDataFrame([(5, "a"), (6, "b")], schema), path).count()
    rows = exact_dedup.exact_dedup(spark.createDataFrame([(7, "a"), (8, "c"), (9, "c"), (None, "b")], schema), path).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.kept) for r in rows) == [(0, 6, False), (7, 5, False), (8, 9, False), (9, 9, True)]


def test_keep_first(with_repeats, nothing):
    kept = exact_dedup.keep_first(with_repeats)
    assert kept.columns == with_repeats.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in with_repeats.collect()})
    assert exact_dedup.keep_first(nothing).count() == 0 and exact_dedup.exact_dedup(nothing).count() == 0


def brute_force(rows, percent=85):
    sets = {}
    for i, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = lowered.encode().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near(odd):
    want = brute_force([(r[0], r[1]) for r in odd_rows()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in odd_sketch_dedup.near_duplicates(odd).collect()}
    assert got == want


@pytest.mark.parametrize("small", [64, 3])
def test_chain_of_edits(spark, monkeypatch, small):
    """A long chain in which only neighbours are alike: hubs alone would miss links, which sketches or prefixes must find."""
    monkeypatch.setattr(odd_sketch_dedup, "SMALL", small)
    monkeypatch.setattr(odd_sketch_dedup, "MOST_WANTED", 10 if small == 3 else 1 << 18)  # texts shuffled, or not
    words = [f"w{i}" for i in range(900)]
    rows = [(7 * i % 101, " ".join(words[4 * i : 4 * i + 100])) for i in range(101)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in odd_sketch_dedup.near_duplicates(df).collect()}
    assert got == brute_force(rows)


def test_near_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_force([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in odd_sketch_dedup.near_duplicates(docs).collect()}
    assert got == want


def test_near_repeats_and_empty(spark, with_repeats, nothing):
    rows = odd_sketch_dedup.near_duplicates(with_repeats).collect()
    assert len(rows) == with_repeats.count()
    want = brute_force([(r[0], r[1]) for r in odd_rows()[:25]])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
    assert odd_sketch_dedup.near_duplicates(nothing).count() == 0
    assert odd_sketch_dedup.keep_one(with_repeats).columns == SCHEMA.names


def test_many_rows_without_id(spark):
    """Rows without an id are documents of their own: only like texts are linked."""
    words = [f"w{i}" for i in range(3000)]
    text = lambda i: " ".join(words[40 * i : 40 * i + 40])
    rows = [(None, text(i % 50)) for i in range(2000)] + [(5, text(3)), (6, text(60)), (6, text(61)), (2, text(61))]
    got = odd_sketch_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    from collections import Counter

    assert Counter((r.doc_id, r.component_id) for r in got) == {(None, None): 1960, (None, 5): 40, (5, 5): 1, (6, 6): 1, (6, 2): 1, (2, 2): 1}
    kept = odd_sketch_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 1960 + 3 and {r.doc_id for r in kept} == {None, 5, 6, 2}


def test_large_template_with_edits(spark):
    """A template with edits from a few variants, in its common part: components as by brute force."""
    import random

    rng = random.Random(3)
    base = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(400):
        w = list(base)
        for at in rng.sample(range(200), rng.choice([1, 3, 5, 9])):
            w[at] = f"v{at}x{rng.randrange(3)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in odd_sketch_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_force(rows)
