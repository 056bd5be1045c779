"""Every query of the subpackage with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from gravelake.llm import entries

from ..test_queries import TABLES, comparable


@pytest.mark.parametrize("name", sorted(entries.ORACLE))
def test_against_sql(spark, sf_dir, name):
    sql = entries.ORACLE[name]
    assert isinstance(sql, str)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = entries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    assert sorted(con.sql(sql).columns) == columns
    want = con.sql(f"select {', '.join(columns)} from ({sql})").fetchall()
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert got and sorted(map(comparable, got)) == sorted(map(comparable, want))
