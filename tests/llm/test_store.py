"""Scratch tables go, finished ones stay; the shared folder must be named on a cluster; batches are bounded."""

import os

import pytest

from gravelake import storage
from gravelake.llm import _store


class Elsewhere:
    """A session on a cluster without a shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)


def test_shared_folder_must_be_named():
    for ask in (_store.shared_dir, storage.shared_folder):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            ask(Elsewhere())


def test_scratch(spark):
    def path(df):
        return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))

    with _store.scratch(spark):
        outer = path(_store.materialise(spark.range(3), "outer"))
        with _store.scratch(spark):
            inner = path(_store.materialise(spark.range(3), "inner"))
            result = _store.finished(spark.range(5), "result")
            kept = path(result)
        assert not os.path.exists(inner) and os.path.exists(kept) and result.count() == 5
        last = path(_store.finished(spark.range(4), "last"))
    assert not os.path.exists(outer) and not os.path.exists(kept) and os.path.exists(last)


def test_bounds(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    for given, want in (("64m", str(16 << 20)), ("1m", "1m"), ("5000", "5000")):
        spark.conf.set(key, given)
        _store.bound_batches(spark)
        assert spark.conf.get(key).removesuffix("b") in (want, str(1 << 20) if want == "1m" else want)
    spark.conf.set(key, before)
    _store.bound_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
