"""URL filters as of fetch time.

A list is a table of dated changes: a pattern was added or removed on a date.
Changes become validity intervals ``[valid_from, valid_to)``.  Every capture
gets the keys that could list it (its host and all parent domains of two or
more labels; host and path up to every segment), and an as-of join keeps the
entries that were in force when the capture was fetched.

Patterns are ``example.com`` (the domain and all below it) or ``host/path``
(that path and all below it), in lower case, without scheme, ``www.`` or port.

The join's equality is on the key and its range on the date.  Both sides are
plain scans, so that adaptive execution can split the captures of a hot host,
and a host's captures are reduced to one row for each (keys, date) before it:
pages of one site that were fetched together are looked up once.

Defined results: a null or unreadable URL, or a null date, matches nothing and
is not blocked; of several changes of one pattern on one date, a removal wins;
of several entries in force the longest pattern, then the smallest, is reported;
rows are independent; other columns are ignored by ``match`` and kept by
``keep_allowed``; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialise


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and a leading ``www.``; empty where there is none."""
    bare = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(bare, r"^www\.", "")


def path_of(url: Column) -> Column:
    """Path without query and fragment, without slashes at its ends."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1), "^/+|/+$", "")


def keys_of(host: Column, path: Column) -> Column:
    """Every pattern that would list a URL of this host and path."""
    labels = F.split(host, r"\.")
    segments = F.split(path, "/+")
    none = F.array().cast("array<string>")
    domains = F.when((host != "") & (F.size(labels) > 1), F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).when(host != "", F.array(host)).otherwise(none)
    prefixes = F.when((host != "") & (path != ""), F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")))).otherwise(none)
    return F.concat(domains, prefixes)


def intervals(changes: DataFrame) -> DataFrame:
    """``pattern, valid_from, valid_to`` from changes ``pattern, changed_on, action`` (``add`` or ``remove``); open intervals end with null."""
    state = changes.filter("pattern is not null and changed_on is not null and action in ('add', 'remove')").groupBy("pattern", "changed_on").agg(F.min(F.col("action") == "add").alias("listed"))
    order = Window.partitionBy("pattern").orderBy("changed_on")
    turned = state.withColumn("was", F.lag("listed", 1, False).over(order)).filter("listed != was")
    return turned.withColumn("valid_to", F.lead("changed_on").over(order)).filter("listed").select("pattern", F.col("changed_on").alias("valid_from"), "valid_to")


def match(captures: DataFrame, changes: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """The captures' rows with ``host, n_active, pattern, blocked`` (columns of those names are replaced)."""
    made = ["host", "n_active", "pattern", "blocked"]
    rest = [c for c in captures.columns if c not in made]
    rows = captures.select(*rest, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("__path"), F.col(fetched).alias("__fetched"))
    rows = rows.withColumn("__keys", keys_of(F.col("host"), F.col("__path"))).drop("__path")
    rows = materialise(rows, "captures")
    looked = rows.filter("size(`__keys`) > 0 and `__fetched` is not null").select("__keys", "__fetched").distinct()
    looked = materialise(looked.select("__keys", "__fetched", F.explode("__keys").alias("pattern")), "lookups")
    listed = materialise(intervals(changes), "intervals")
    active = looked.join(listed, "pattern").filter("`__fetched` >= valid_from and (valid_to is null or `__fetched` < valid_to)")
    found = active.groupBy("__keys", "__fetched").agg(F.count(F.lit(1)).alias("n_active"), F.min(F.struct((-F.length("pattern")).alias("l"), F.col("pattern").alias("p"))).alias("x"))
    found = materialise(found.select("__keys", "__fetched", "n_active", F.col("x.p").alias("pattern")), "matches")
    joined = rows.join(found, ["__keys", "__fetched"], "left")
    return joined.select(*rest, "host", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), "pattern", F.col("n_active").isNotNull().alias("blocked"))


def keep_allowed(captures: DataFrame, changes: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """The captures that no entry blocked when they were fetched, with their own columns."""
    hidden = {c: f"__own_{c}" for c in ("host", "n_active", "pattern", "blocked") if c in captures.columns}
    found = match(captures.withColumnsRenamed(hidden), changes, hidden.get(url, url), hidden.get(fetched, fetched))
    return found.filter("not blocked").select(*[F.col(hidden.get(c, c)).alias(c) for c in captures.columns])


def dated_list(pages: DataFrame) -> DataFrame:
    """A list for these pages: for about a third of hosts and of first path segments, an addition, a removal and sometimes a second addition, at dates that follow from a hash."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    named = pages.select(F.explode(F.array(host, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.concat(host, F.lit("/"), F.split_part(path, F.lit("/"), F.lit(1))))).alias("pattern")).filter("pattern != '' and pattern not like '%/'").distinct()
    number = lambda at: F.conv(F.substring(F.md5("pattern"), at, 6), 16, 10).cast("long")
    day = number(7) % 200
    some = named.filter(number(1) % 3 == 0).select("pattern", day.alias("a"), (day + 20 + number(13) % 100).alias("b"), (number(19) % 2 == 0).alias("again"))
    steps = F.array(F.struct(F.col("a").alias("d"), F.lit("add").alias("action")), F.struct(F.col("b").alias("d"), F.lit("remove").alias("action")), F.struct(F.when(F.col("again"), F.col("b") + 40).alias("d"), F.lit("add").alias("action")))
    return some.select("pattern", F.explode(steps).alias("x")).filter("x.d is not null").select("pattern", F.date_add(F.lit("2024-01-01").cast("date"), F.col("x.d").cast("int")).alias("changed_on"), "x.action")


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every page against the entries in force on its fetch date (a fixed function of its id)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 365).cast("int")))
    return match(captures, dated_list(pages)).select("page_id", "host", F.col("fetched_on").cast("string").alias("fetched_on"), "n_active", "pattern", "blocked")


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id * 7919 % 365 AS INTEGER) AS fetched_on,
         regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '') AS host,
         regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '^/+|/+$', '', 'g') AS path
  FROM pages),
named AS (
  SELECT DISTINCT pattern FROM (
    SELECT unnest([host, regexp_extract(host, '([^.]+\.[^.]+)$', 1), host || '/' || split_part(path, '/', 1)]) AS pattern FROM p)
  WHERE pattern <> '' AND pattern NOT LIKE '%/'),
hashed AS (
  SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 6) AS BIGINT) AS h1, CAST('0x' || substr(md5(pattern), 7, 6) AS BIGINT) % 200 AS a,
         CAST('0x' || substr(md5(pattern), 13, 6) AS BIGINT) AS h3, CAST('0x' || substr(md5(pattern), 19, 6) AS BIGINT) AS h4 FROM named),
spans AS (
  SELECT pattern, a AS f, a + 20 + h3 % 100 AS t FROM hashed WHERE h1 % 3 = 0
  UNION ALL SELECT pattern, a + 20 + h3 % 100 + 40, NULL FROM hashed WHERE h1 % 3 = 0 AND h4 % 2 = 0),
dated AS (SELECT pattern, DATE '2024-01-01' + CAST(f AS INTEGER) AS valid_from, DATE '2024-01-01' + CAST(t AS INTEGER) AS valid_to FROM spans),
parts AS (SELECT *, string_split(host, '.') AS labels, string_split_regex(path, '/+') AS segments FROM p WHERE host <> ''),
keys AS (
  SELECT page_id, unnest(CASE WHEN len(labels) > 1 THEN list_transform(range(1, len(labels)), lambda i: array_to_string(labels[i:], '.')) ELSE [host] END) AS pattern FROM parts
  UNION ALL
  SELECT page_id, unnest(list_transform(range(1, len(segments) + 1), lambda i: host || '/' || array_to_string(segments[1:i], '/'))) FROM parts WHERE path <> ''),
hits AS (
  SELECT k.page_id, d.pattern FROM keys k JOIN dated d USING (pattern) JOIN p USING (page_id)
  WHERE p.fetched_on >= d.valid_from AND (d.valid_to IS NULL OR p.fetched_on < d.valid_to)),
best AS (SELECT page_id, count(*) AS n, arg_min(pattern, (-length(pattern), pattern)) AS pattern FROM hits GROUP BY page_id)
SELECT p.page_id, p.host, CAST(p.fetched_on AS VARCHAR) AS fetched_on, CAST(coalesce(b.n, 0) AS BIGINT) AS n_active, b.pattern, b.n IS NOT NULL AS blocked
FROM p LEFT JOIN best b USING (page_id)
"""
