"""Findings of the second round: ties, distances computed once, whole tables, joins that are not repeated."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gravelake.operators import lightcone, phase_space
from gravelake.plans import catalogues
from gravelake.plans import queries as q
from tests.test_queries import comparable


def joins(df):
    return sum("Join" in line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_peak_of_equal_masses(spark, sf_dir, tmp_path):
    """Of equal masses the first is the peak, as in the SQL."""
    con = duckdb.connect()
    con.sql(f"copy (select * replace (round(o_totalprice / 200000) as o_totalprice, o_custkey % 5 as o_custkey) from '{sf_dir}/orders.parquet') to '{tmp_path}/orders.parquet' (format parquet)")
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    df = q.QUERIES["running_peak"](spark, str(tmp_path))
    want = con.sql(f"select {', '.join(df.columns)} from ({q.ORACLE['running_peak']})").fetchall()
    assert sorted(map(comparable, map(tuple, df.collect()))) == sorted(map(comparable, want))


def test_distances_are_computed_once(spark, sf_dir):
    """A radius and the distances compared with it come from one pass: members meet their centre in one join."""
    assert joins(q.QUERIES["halo_statistics"](spark, sf_dir)) == 1


def test_all_groups_have_outputs(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest tables have ten groups
    groups = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey").distinct().count()
    assert q.QUERIES["halo_outputs"](spark, sf_dir).count() == groups > 61


@pytest.mark.parametrize("name,most", [("merge_targets", 1), ("progenitor_lists", 3)])
def test_joins_are_not_repeated(spark, sf_dir, name, most):
    assert joins(q.QUERIES[name](spark, sf_dir)) <= most


def test_tasks_stay_small(spark, monkeypatch):
    """More rows are dealt to more tasks: a chain of 60 nodes, and a slab of 60 rows, in tasks of about 2."""
    monkeypatch.setattr(phase_space, "ROWS", 2)
    monkeypatch.setattr(catalogues, "ROWS", 2)
    tree = spark.range(60).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(1).cast("long").alias("n"))
    assert {r.id: r.total for r in phase_space.child_totals(tree).collect()} == {i: 60 - i for i in range(60)}
    parts, numbered = [], catalogues.numbered
    monkeypatch.setattr(catalogues, "numbered", lambda *a: parts.append(a[-1]) or numbered(*a))
    placed = catalogues.transposed(spark.range(60).select(F.expr("id * 7 % 60").alias("pid"), F.lit(1).alias("slab")))
    assert parts == [30]
    assert {r.pid: r.place for r in placed.collect()} == {i: i for i in range(60)}


def test_crossings_are_computed_once(spark, sf_dir):
    """Both distances of a crossing stand in the plan once: a filter that repeats them is too long to be compiled."""
    assert q.QUERIES["light_cone"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("SQRT(") == 2
    rows = [(1, 0.43, 0.0), (2, None, 0.0), (3, 0.39, 0.0), (4, 0.43, 9.0)]
    p = spark.createDataFrame(rows, "pid long, x double, frac double").withColumns({c: F.lit(0.0) for c in ("y", "z", "wx", "wy", "wz")})
    met = lightcone.crossings(p, 0.45, 0.40)
    assert {r.pid: round(r.frac, 9) for r in met.collect()} == {1: 0.4, 4: 0.4}
    assert set(met.columns) == {"pid", "frac", *[k + c for c in "xyz" for k in ("", "w", "p")]}


@pytest.mark.parametrize("rows,kind", [(150_000, "decimal(38,0)"), (60_000, "bigint")])
def test_totals_of_identifiers_are_exact(spark, tmp_path, rows, kind):
    """Where the SQL has totals they are LONG as there; where one does not fit, the SQL fails and they are exact."""
    con, sql = duckdb.connect(), q.ORACLE["time_slice"]
    con.sql(f"""copy (select 524287::bigint as l_orderkey, i % 30000 as l_partkey, 7::bigint as l_suppkey, 1::integer as l_linenumber, 30.0::double as l_quantity,
      0.05::double as l_discount, 0.02::double as l_tax, 900.0::double as l_extendedprice from range({rows}) r(i)) to '{tmp_path}/lineitem.parquet' (format parquet)""")
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    if kind != "bigint":
        with pytest.raises(duckdb.ConversionException):
            con.sql(sql).fetchall()
        sql = sql.replace("CAST(sum(a) AS BIGINT)", "sum(a)")
    df = q.QUERIES["time_slice"](spark, str(tmp_path))
    assert dict(df.dtypes)["pids"] == kind
    got = {(r.slab, r.in_group): (r.n, int(r.pids), r.roots) for r in df.collect()}
    want = con.sql(f"select slab, in_group, n, pids, roots from ({sql})").fetchall()
    assert got == {(slab, inside): (n, int(pids), roots) for slab, inside, n, pids, roots in want}
