"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from gravelake.plans import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def comparable(row):
    return tuple((x is None, "" if x is None else str(type(x)), 0 if x is None else x) for x in (None if isinstance(v, float) and math.isnan(v) else v for v in row))


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_against_sql(spark, con, sf_dir, name):
    df = q.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    relation = con.sql(q.ORACLE[name])
    assert sorted(relation.columns) == columns
    want = con.sql(f"select {', '.join(columns)} from ({q.ORACLE[name]})").fetchall()
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(map(comparable, got)) == sorted(map(comparable, want))


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE)))
def test_runs(spark, sf_dir, name):
    assert q.QUERIES[name](spark, sf_dir).count() > 0
