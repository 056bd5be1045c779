"""Statistics against plain Python; the estimate against numpy; verdicts."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gravelake.llm import quality_rules as q

from .conftest import odd_rows, sentence


def plain(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    n = len(words)
    lines = [x for x in text.split("\n") if x.encode().split()]
    seen = Counter(tuple(words[k : k + 5]) for k in range(n - 4))
    cover = set()
    for k in range(n - 4):
        if seen[tuple(words[k : k + 5])] > 1:
            cover |= set(range(k, k + 5))
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_statistics(odd):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in q.judge(odd).collect()}
    assert got == {r[0]: plain(r[1]) for r in odd_rows()}


def test_no_python_in_the_plan(odd):
    plan = q.judge(odd)._jdf.queryExecution().executedPlan().toString() + q.statistics(odd.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chi_squared():
    assert q.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    x = q.chi2_quantile(1 - 1e-8, 5)  # the tail of five degrees of freedom in closed form
    tail = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
    assert tail == pytest.approx(1e-8, rel=1e-3)


def test_estimate_resists_outliers(spark):
    """A fifth of far rows moves the classical moments and not the estimate."""
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(5, 5)) * 0.5 + np.eye(5) * 2
    good = rng.normal(size=(4000, 5)) @ mix
    bad = rng.normal(size=(1000, 5)) + 25
    rows = [("g", i % q.SALTS, *map(float, x)) for i, x in enumerate(np.vstack([good, bad]))]
    df = spark.createDataFrame(rows, "gid string, salt int, " + ", ".join(f"x{i} double" for i in range(5))).cache()
    p = q.estimate(df, True).collect()[0]
    assert np.allclose(list(q.estimate(df, False).collect()[0])[1:], list(p)[1:])  # salted instead of broadcast
    mean = np.array([p[f"m{i}"] for i in range(5)])
    low = np.array([[p[f"l{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    floors = np.diag([f**2 for f in q.FLOORS.values()])
    assert np.abs(mean - good.mean(0)).max() < 0.25
    want = np.cov(good.T) + floors
    assert np.abs(low @ low.T - want).max() < 0.15 * np.abs(want).max()
    y = np.linalg.solve(low, (np.vstack([good, bad]) - mean).T)
    by_numpy = (y**2).sum(0)
    by_spark = [r.d for r in df.crossJoin(spark.createDataFrame([p]).drop("gid")).select(q._distance().alias("d")).collect()]
    assert np.allclose(sorted(by_numpy), sorted(by_spark))
    assert (by_numpy[:4000] < q.chi2_quantile(1 - q.TAIL, 5)).all() and (by_numpy[4000:] > q.chi2_quantile(1 - q.TAIL, 5)).all()


def test_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = q.judge(docs).join(labels, "doc_id").filter("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    poor = [r.kept for r in rows if r.quality == 0]
    assert all(good) and sum(poor) <= 0.2 * len(poor)


def test_small_groups_are_judged(spark):
    """Rare and null languages and sources: by their language, or the corpus, in every case with a distance."""
    rng = random.Random(3)
    text = lambda: sentence(rng, rng.randint(40, 60))
    junk = lambda: " ".join("#" + "".join(rng.choice("#$%&*") for _ in range(6)) for _ in range(50))
    groups = [("en", "s0")] * 200 + [("de", "s0")] * 60 + [("en", "rare")] * 4 + [("en", None)] * 4 + [("xx", "s0")] * 4 + [(None, None)] * 4
    rows = [(i, text(), *g) for i, g in enumerate(groups)]
    small = [("en", "rare"), ("en", None), ("xx", "s0"), (None, None)]
    bad = [(1000 + i, junk(), *g) for i, g in enumerate(small)]
    schema = "doc_id long, text string, lang string, source string"
    got = q.judge(spark.createDataFrame(rows + bad, schema)).collect()
    assert not any(r.base_failed for r in got) and all(r.distance is not None for r in got)
    assert {r.doc_id for r in got if not r.kept} == {r[0] for r in bad}
    few = q.judge(spark.createDataFrame(rows[:5], schema)).collect()
    assert len(few) == 5 and all(r.distance is not None for r in few)


def test_small_and_odd_tables(odd, with_repeats, nothing):
    assert q.judge(nothing).count() == 0 and q.keep_good(nothing).columns == nothing.columns
    rows = q.judge(with_repeats).collect()
    assert len(rows) == with_repeats.count()
    kept = q.keep_good(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in q.judge(odd).filter("kept").collect()}
    assert not math.isnan(q.judge(odd).agg(F.max("distance")).first()[0] or 0.0)


def plain_mcd(x):
    """The estimate in numpy: two starts, concentration steps on binned distances, one reweighting."""
    floors = np.array(list(q.FLOORS.values()))

    def moments(rows, scale):
        return rows.mean(0), scale * np.cov(rows.T, bias=True) + np.diag(floors**2)

    def far(rows, m, c):
        return (np.linalg.solve(np.linalg.cholesky(c), (rows - m).T) ** 2).sum(0)

    def quantile(bins, share):
        values, n = np.unique(bins, return_counts=True)
        return values[np.searchsorted(np.cumsum(n), share * len(bins))]

    bins = np.floor(x / (floors / 4))
    low, mid, high = ([quantile(bins[:, i], s) for i in range(5)] for s in (0.25, 0.5, 0.75))
    robust = (np.array(mid) + 0.5) * floors / 4, np.diag(((np.array(high) - np.array(low)) * (floors / 4) / 1.349) ** 2 + floors**2)
    ends = []
    for start in (robust, moments(x, 1.0)):
        m, c = start
        for _ in range(q.STEPS):
            own = np.floor(np.log1p(far(x, m, c)) * 64)
            m, c = moments(x[own <= quantile(own, q.SUPPORT)], q._consistency(q.SUPPORT))
        ends.append((np.log(np.diag(np.linalg.cholesky(c))).sum(), m, c))
    _, m, c = min(ends, key=lambda e: e[0])
    m, c = moments(x[far(x, m, c) <= q.chi2_quantile(0.975, 5)], q._consistency(0.975))
    return far(x, m, c)


def test_verdicts_against_plain_mcd(spark):
    rng = random.Random(9)
    texts = [sentence(rng, rng.randint(15, 200)) for _ in range(300)] + [" ".join("#" + "".join(rng.choice("#$%&*") for _ in range(6)) for _ in range(50)), " ".join(f"averyveryverylongword{i}" * 9 for i in range(90)), "a\n" * 3 + sentence(rng, 30)]
    got = {r.doc_id: r for r in q.judge(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string"), most_groups=rng.choice([0, 9])).collect()}
    rows = []
    for i, t in enumerate(texts):
        n, chars, symbols, dup, rep = plain(t)
        lines = sum(bool(x.encode().split()) for x in t.split("\n"))
        failed = n < 10 or 100 * rep > 20 * n
        assert got[i].base_failed == failed
        if not failed:
            rows.append((i, [math.log1p(n), math.log((chars + 500) / (n + 100)), math.sqrt(symbols / max(chars, 1)), math.sqrt(dup / max(lines, 1)), math.sqrt(rep / max(n, 1))]))
    far = plain_mcd(np.array([v for _, v in rows]))
    assert np.allclose(far, [got[i].distance for i, _ in rows], rtol=1e-6)
    assert [got[i].kept for i, _ in rows] == (far <= q.chi2_quantile(1 - q.TAIL, 5)).tolist()
    assert not all(got[i].kept for i, _ in rows)


def test_rows_that_share_an_id(spark):
    """Verdicts are by row: a bad text goes although a good one has its id, or has none like it."""
    rng = random.Random(4)
    good = [sentence(rng, 60) for _ in range(40)]
    rows = [(i, t, "en", "s") for i, t in enumerate(good)] + [(1, "one", "en", "s"), (None, "two", "en", "s"), (None, good[0], "en", "s"), (None, None, None, None)]
    kept = q.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(kept) == 41 and {r.text for r in kept} == set(good)
    shuffled = q.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), most_rejected=0).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, kept))
