"""Particle, halo and map views of the test tables, with the same arithmetic in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIME = 1_000_003


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pid, x, y, z, vx, vy, vz, dens, grp`` from lineitem; positions in the unit box centred on 0."""
    place = lambda e: F.expr(f"({e}) % {PRIME} / cast({PRIME} as double) - 0.5")
    return table(spark, sf_dir, "lineitem").select(
        F.expr("((l_orderkey * 32768 + l_partkey) * 1024 + l_suppkey) * 8 + l_linenumber").alias("pid"),
        place("l_orderkey * 7919 + l_linenumber * 104729").alias("x"),
        place("l_partkey * 15485863 + l_linenumber * 7").alias("y"),
        place("l_suppkey * 32452843 + l_orderkey * 13").alias("z"),
        (F.col("l_quantity") - 25).alias("vx"),
        (F.col("l_discount") * 100 - 5).alias("vy"),
        (F.col("l_tax") * 100 - 4).alias("vz"),
        F.col("l_extendedprice").alias("dens"),
        F.col("l_suppkey").alias("grp"),
    )


P = f"""p AS (SELECT ((l_orderkey * 32768 + l_partkey) * 1024 + l_suppkey) * 8 + l_linenumber AS pid,
  (l_orderkey * 7919 + l_linenumber * 104729) % {PRIME} / CAST({PRIME} AS DOUBLE) - 0.5 AS x,
  (l_partkey * 15485863 + l_linenumber * 7) % {PRIME} / CAST({PRIME} AS DOUBLE) - 0.5 AS y,
  (l_suppkey * 32452843 + l_orderkey * 13) % {PRIME} / CAST({PRIME} AS DOUBLE) - 0.5 AS z,
  l_quantity - 25 AS vx, l_discount * 100 - 5 AS vy, l_tax * 100 - 4 AS vz, l_extendedprice AS dens, l_suppkey AS grp
  FROM lineitem)"""


def halos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, size, mass, x, y, z, r, vmax`` of orders with their lines as members."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("size"), F.sum("l_quantity").alias("mass"))
    place = lambda k: F.expr(f"(o_orderkey * {k}) % {PRIME} / cast({PRIME} as double) - 0.5")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", place(7919).alias("x"), place(15485863).alias("y"), place(32452843).alias("z"))
    return orders.join(lines, "id").select("id", "size", "mass", "x", "y", "z", (F.lit(0.002) + F.col("size") * 0.002).alias("r"), F.sqrt("o_totalprice").alias("vmax"))


H = f"""h AS (SELECT o_orderkey AS id, size, mass,
  (o_orderkey * 7919) % {PRIME} / CAST({PRIME} AS DOUBLE) - 0.5 AS x, (o_orderkey * 15485863) % {PRIME} / CAST({PRIME} AS DOUBLE) - 0.5 AS y,
  (o_orderkey * 32452843) % {PRIME} / CAST({PRIME} AS DOUBLE) - 0.5 AS z, CAST(0.002 AS DOUBLE) + size * CAST(0.002 AS DOUBLE) AS r, sqrt(o_totalprice) AS vmax
  FROM orders JOIN (SELECT l_orderkey, count(*) AS size, sum(l_quantity) AS mass FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse pixel map ``step, pix, is_halo, n, w0, w1`` from events, on 12 * 4**2 pixels."""
    return table(spark, sf_dir, "events").select(
        F.expr("cast(event_id % 7 as int)").alias("step"),
        F.expr("user_id * 31 % 192").alias("pix"),
        F.col("event_type").isin("purchase", "click").alias("is_halo"),
        F.expr("event_id % 5 + 1").alias("n"),
        F.col("value").alias("w0"),
        (F.col("value") * F.expr("cast(event_id % 3 as double)")).alias("w1"),
    )


X = """x AS (SELECT CAST(event_id % 7 AS INTEGER) AS step, user_id * 31 % 192 AS pix, event_type IN ('purchase', 'click') AS is_halo,
  event_id % 5 + 1 AS n, value AS w0, value * CAST(event_id % 3 AS DOUBLE) AS w1 FROM events)"""


def neighbour_sql(left: str, right: str, radius: float, columns: str, key_left: str, key_right: str) -> str:
    """SQL of the pairs of two point tables within a radius in the periodic unit box, through cells."""
    n = max(1, int(1 / radius))
    cell = lambda c: f"((CAST(floor(({c} + 0.5) * {n}) AS BIGINT) % {n} + {n}) % {n})"
    near = " + ".join(f"(l.{c} - r.{c} - round_even(l.{c} - r.{c}, 0)) * (l.{c} - r.{c} - round_even(l.{c} - r.{c}, 0))" for c in "xyz")
    return f"""SELECT {columns}, {near} AS d2 FROM (SELECT *, ({cell('x')} * {n} + {cell('y')}) * {n} + {cell('z')} AS cell FROM {left}) l
      JOIN (SELECT DISTINCT {right}.*, ((({cell('x')} + a.o + {n}) % {n}) * {n} + ({cell('y')} + b.o + {n}) % {n}) * {n} + ({cell('z')} + c.o + {n}) % {n} AS cell
            FROM {right}, (VALUES (-1), (0), (1)) a(o), (VALUES (-1), (0), (1)) b(o), (VALUES (-1), (0), (1)) c(o)) r
      ON l.cell = r.cell WHERE {near} < {radius!r} * {radius!r}"""
