"""Trees against a row-at-a-time walk, features against plain Python, held-out quality."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gravelake.llm import quality_gbt as q
from gravelake.llm._words import as_binary, buffer_of

from .conftest import odd_rows


def matrix(texts):
    return q.document_features(*buffer_of(as_binary(pa.array(texts, pa.string()))))


def test_features_do_not_depend_on_neighbours():
    texts = [r[1] for r in odd_rows()]
    together = matrix(texts)
    assert np.isfinite(together).all()
    for i, t in enumerate(texts):
        assert np.allclose(together[i], matrix([t])[0], atol=1e-6), i


def test_some_features():
    x = dict(zip(q.FEATURES, matrix(["The the a a\na a\na a ##"])[0], strict=True))
    assert x["log_words"] == pytest.approx(np.log1p(9))
    assert x["distinct_words"] == pytest.approx(4 / 9) and x["top_word"] == pytest.approx(6 / 9)
    assert x["repeat_next"] == pytest.approx(5 / 9) and x["symbols"] == pytest.approx(2 / 22, abs=0.01)
    assert matrix([None])[0][q.FEATURES.index("empty")] == 1


def test_flat_trees_walk_right():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    forest = q.fit_forest(x, y, trees=40)
    score = forest.score(x)
    assert ((score > 0.5) == y).mean() > 0.97
    for i in range(20):
        total = forest.start
        for node in forest.roots:
            while forest.feature[node] >= 0:
                node = forest.left[node] if x[i, forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        assert score[i] == pytest.approx(1 / (1 + np.exp(-total)))
    empty = q.fit_forest(np.zeros((0, 6), np.float32), np.zeros(0))
    assert (empty.score(x[:5]) == 0.5).all()


def test_held_out_quality(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = q.op5_quality_gbt(spark, sf_dir).join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    y = np.array([r.quality for r in rows])
    s = np.array([r.score for r in rows])
    rank = np.empty(len(s))
    rank[np.argsort(s)] = np.arange(len(s))
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    accuracy = np.mean([r.predicted == r.quality for r in rows])
    print("auc", auc, "accuracy", accuracy)
    assert auc > 0.97 and accuracy > 0.95


def test_odd_tables(spark, odd, nothing, with_repeats):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (3, 1)], "doc_id long, quality int")
    scored = q.classify(odd, labels).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert q.classify(nothing, labels).count() == 0
    assert {r.score for r in q.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert q.classify(with_repeats, labels).count() == with_repeats.count()
    by_text = q.classify(odd, labels).join(odd.select("doc_id", "text"), "doc_id").groupBy("text").agg(F.countDistinct("score").alias("n"))
    assert by_text.filter("n != 1").count() == 0
