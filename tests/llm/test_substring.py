"""Repeated passages against brute force."""

import hashlib
import random
from collections import Counter

from gravelake.llm import substring_dedup

from .conftest import odd_rows, sentence


def brute_force(rows, window=35):
    split = {i: (text or "").encode().split() for i, text in rows}
    seen = Counter(tuple(w[k : k + window]) for w in split.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        last = -1
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                for j in range(max(k, last), k + window):
                    gone[j] = True
                last = k + window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeated(df).collect()}


def test_odd(odd):
    assert result(odd) == brute_force([(r[0], r[1]) for r in odd_rows()])


def test_random_overlaps(spark):
    rng = random.Random(3)
    pool = [f"v{i}" for i in range(4)]
    passages = [[rng.choice(pool) + str(rng.randint(0, 30)) for _ in range(rng.randint(30, 90))] for _ in range(12)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 10)
            words += p[a : len(p) - rng.randint(0, 8)] if rng.random() < 0.5 else [f"u{rng.randint(0, 500)}" for _ in range(rng.randint(1, 40))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rows.append((80, " ".join(["the"] * 300)))
    rows.append((81, " ".join(["a", "b"] * 30)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_force(rows)
    assert sum(w[1] > 0 for w in want.values()) > 20
    assert result(df) == want


def test_repeats_and_empty(spark, with_repeats, nothing):
    rows = substring_dedup.remove_repeated(with_repeats)
    assert rows.count() == with_repeats.count()
    same = spark.createDataFrame([(1, "z " * 40), (1, "z " * 40), (1, "y " * 3), (None, "z " * 40)], "doc_id long, text string")
    assert sorted((r.n_words, r.n_removed) for r in substring_dedup.remove_repeated(same).collect()) == [(3, 0), (40, 40), (40, 40), (40, 40)]
    assert substring_dedup.remove_repeated(nothing).count() == 0


def test_many_rows_without_id(spark):
    """Thousands of rows without an id, copies among them: each is looked up by its own text."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [sentence(rng, 20, 10**6) + (" " + passage if i % 40 == 0 else "") for i in range(2000)] + [passage + " end"] * 1000
    rows = [(None, t) for t in texts] + [(1, texts[0]), (1, texts[40]), (1, texts[41])]
    got = substring_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute_force(list(enumerate(t for _, t in rows)))
    assert Counter((r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(want.values())
    assert sorted((r.n_words, r.n_removed) for r in got if r.doc_id == 1) == sorted(want[3000 + i][:2] for i in range(3))
