"""Quality rules: multivariate outliers by minimum-covariance-determinant estimates.

Every document gets a vector of transformed statistics (length, word length,
symbols, repeated lines, repeated words).  For each language and source the
location and scatter of the cleanest part of the documents are estimated, and
documents at a large Mahalanobis distance from it are rejected.  DataFrame
functions only.

Estimation is deterministic and needs no gathering: from two starts
(coordinatewise quantiles; classical moments) concentration steps keep the
``SUPPORT`` share of a group's documents with the smallest distances.  Their
quantile is read from counts over fixed distance bins and the moments are
partial aggregates, so a hot source costs one row for each task and bin.  Up to
``MOST_GROUPS`` groups their parameters are broadcast; beyond that documents
meet them by (group, salt), so that a hot source's documents go to many tasks.
The start with the smaller determinant wins and is reweighted once.  Scatter
matrices get ``FLOORS`` on their diagonals, so that a statistic that is
constant in a group does not reject the first document that differs a little.

A group is a language and source with at least ``LEAST`` documents that pass
the base rules; smaller ones are pooled by language.  Where that is still too
small, the documents are judged by an estimate over the whole language, and if
that is too small as well, over the whole corpus, however small it is.  So every
document that passes the base rules has a distance.

Defined results: null text has no words and fails the base rules; null
language or source is a value of its own; every row is judged on its own text,
also where rows share an id or have none, and repeated rows get equal verdicts;
other columns, whatever their names, are ignored by ``judge`` and kept by
``keep_good``; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import finished, materialise, scratch, text_columns

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Names of the transformed statistics and the smallest standard deviation of each.
FLOORS = {"length": 0.3, "word_length": 0.03, "symbols": 0.02, "dup_lines": 0.15, "repeats": 0.15}
SUPPORT, STEPS, LEAST = 0.6, 4, 30
#: Share of clean documents that the distance cut would reject if they were normal.
TAIL = 1e-8
#: Words of average length that steady the word length of short texts.
STEADY, USUAL = 100, 5
_NAMES = list(FLOORS)
_P = len(FLOORS)
_BINS = 64  # distance bins in a factor of e
#: Groups whose parameters (24 numbers each, for two starts) are broadcast, 8 MB at most; parts of a group beyond that.
MOST_GROUPS, SALTS = 20_000, 32
#: Rejected rows that are broadcast, 8 bytes each: 8 MB at most.
MOST_REJECTED = 1 << 20


def chi2_cdf(x: float, df: int) -> float:
    """Distribution function of chi-squared, by the series of the incomplete gamma function."""
    a, t = df / 2, x / 2
    if t <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= t / k
        total += term
    return min(1.0, total * math.exp(-t + a * math.log(t) - math.lgamma(a)))


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < p else (low, mid)
    return low


def _consistency(share: float) -> float:
    """What the scatter of the inner ``share`` of a normal sample is multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, _P), _P + 2)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def statistics(docs: DataFrame) -> DataFrame:
    """The input's rows with the integer statistics of their whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = text
    for c in SPACE:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    plain = text
    for c in SYMBOLS:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    trimmed = F.trim(text, F.lit(SPACE))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+", -1)).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.select(
        *[c for c in docs.columns if c != "text"],
        F.transform(words, lambda w: F.xxhash64(w)).alias("__words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(plain)).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
    )

    def windows(h: Column) -> Column:
        return F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))

    rest = [c for c in docs.columns if c != "text"]
    two = one.select(
        *rest,
        "word_chars",
        "n_symbols",
        F.size("__words").cast("long").alias("n_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _let(F.col("__words"), windows).alias("__windows"),
    )
    three = two.withColumn("__n_distinct", F.size(F.array_distinct("__windows")))

    def twice(w: Column) -> Column:
        """Begins of the windows whose hash occurs twice or more, ascending."""
        ordered = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(
            ordered,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(s, lambda x, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])) | ((k < F.size(s) - 1) & (s[F.least(k + 1, F.size(s) - 1)]["h"] == x["h"]))),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(b: Column) -> Column:
        """Words under windows that begin at ``b``."""
        reach = F.zip_with(b, F.slice(b, 2, F.size(b)), lambda x, y: F.least(F.lit(WINDOW), F.coalesce(y, x + WINDOW) - x))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    repeats = F.when(F.col("__n_distinct") == F.size("__windows"), F.lit(0)).otherwise(_let(twice(F.col("__windows")), covered))
    return three.select(*rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.cast("long").alias("n_repeat_words"), "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def transformed() -> list[Column]:
    """The vector of transformed statistics, in the order of ``FLOORS``."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return [
        F.log1p(words.cast("double")),
        F.log((chars + STEADY * USUAL) / (words + STEADY).cast("double")),
        F.sqrt(F.col("n_symbols") / F.greatest(chars, F.lit(1)).cast("double")),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)).cast("double")),
        F.sqrt(F.col("n_repeat_words") / F.greatest(words, F.lit(1)).cast("double")),
    ]


def _distance() -> Column:
    """Squared Mahalanobis distance from location m* and Cholesky factor l*_*."""
    y: list[Column] = []
    for i in range(_P):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}_{j}") * y[j]
        y.append(rest / F.col(f"l{i}_{i}"))
    return sum((v * v for v in y), F.lit(0.0))


def _factored(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Cholesky factors of scatter matrices c*_*, with their log determinants."""
    out = moments
    for i in range(_P):
        for j in range(i + 1):
            rest = F.col(f"c{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            out = out.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}_{j}"))
    log_det = sum((F.log(F.col(f"l{i}_{i}")) for i in range(_P)), F.lit(0.0))
    return out.select(*keys, *[f"m{i}" for i in range(_P)], *[f"l{i}_{j}" for i in range(_P) for j in range(i + 1)], log_det.alias("log_det"))


def _moments(rows: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Location and scatter of each group, the scatter scaled and floored."""
    floors = list(FLOORS.values())
    aggs = [F.avg(f"x{i}").alias(f"m{i}") for i in range(_P)]
    aggs += [(scale * F.covar_pop(f"x{i}", f"x{j}") + (floors[i] ** 2 if i == j else 0.0)).alias(f"c{i}_{j}") for i in range(_P) for j in range(i + 1)]
    return _factored(rows.groupBy(*keys).agg(*aggs), keys)


def _quantile_bins(rows: DataFrame, keys: list[str], bin_column: str, shares: dict[str, float]) -> DataFrame:
    """For each key the first bin at which the cumulated count reaches each share."""
    from pyspark.sql import Window

    counts = rows.groupBy(*keys, bin_column).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*keys)
    upto = counts.select(*keys, bin_column, F.sum("n").over(own.orderBy(bin_column)).alias("upto"), F.sum("n").over(own).alias("all"))
    return upto.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= s * F.col("all"), F.col(bin_column))).alias(name) for name, s in shares.items()])


def _beside(rows: DataFrame, params: DataFrame, keys: list[str], few: bool, how: str = "inner") -> DataFrame:
    """``rows`` with the parameters of their group; ``rows`` have a ``salt``."""
    if few:
        return rows.join(F.broadcast(params), keys, how)
    salted = params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, [*keys, "salt"], how)


def estimate(rows: DataFrame, few: bool) -> DataFrame:
    """Location and scatter of every group from rows ``gid, salt, x0 ..``; ``rows`` is read many times, ``few``: at most ``MOST_GROUPS`` groups."""
    classical = _moments(rows, ["gid"], 1.0).withColumn("start", F.lit(1))
    floors = list(FLOORS.values())
    vectors = [f"x{i}" for i in range(_P)]
    long = rows.select("gid", F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.floor(F.col(f"x{i}") / (floors[i] / 4)).alias("bin")) for i in range(_P)])).alias("x")).select("gid", "x.d", "x.bin")
    quartiles = _quantile_bins(long, ["gid", "d"], "bin", {"low": 0.25, "mid": 0.5, "high": 0.75})
    aggs = []
    for i in range(_P):
        at = lambda name, i=i: F.max(F.when(F.col("d") == i, F.col(name)))
        aggs += [((at("mid") + 0.5) * (floors[i] / 4)).alias(f"m{i}"), (F.pow((at("high") - at("low")) * (floors[i] / 4) / 1.349, 2) + floors[i] ** 2).alias(f"c{i}_{i}")]
        aggs += [F.lit(0.0).alias(f"c{i}_{j}") for j in range(i)]
    robust = _factored(quartiles.groupBy("gid").agg(*aggs), ["gid"]).withColumn("start", F.lit(0))
    params = materialise(robust.unionByName(classical), "mcd-starts")
    keys = ["gid", "start"]
    for _ in range(STEPS):
        placed = _beside(rows, params, ["gid"], few).select(*keys, "salt", *vectors, F.floor(F.log1p(_distance()) * _BINS).alias("bin"))
        cut = _quantile_bins(placed, keys, "bin", {"cut": SUPPORT})
        params = materialise(_moments(_beside(placed, cut, keys, few).filter("bin <= cut"), keys, _consistency(SUPPORT)), "mcd-step")
    best = params.groupBy("gid").agg(F.min(F.struct("log_det", "start")).alias("x")).select("gid", F.col("x.start").alias("start"))
    raw = materialise(params.join(best, keys).drop("start", "log_det"), "mcd-raw")
    inner = _beside(rows, raw, ["gid"], few).filter(_distance() <= chi2_quantile(0.975, _P))
    return materialise(_moments(inner.select("gid", *vectors), ["gid"], _consistency(0.975)), "mcd")


def _verdicts(rows: DataFrame, tail: float, most_groups: int) -> DataFrame:
    """Stored ``_measured`` rows with ``kept`` and ``distance``; the groups' parameters are ``finished``."""
    sizes = materialise(rows.filter("not base_failed").groupBy("l", "s").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    few = sizes.count() <= most_groups
    pooled = sizes.filter(f"n < {LEAST}").groupBy("l").agg(F.sum("n").alias("pool"))
    whole = sizes.groupBy("l").agg(F.sum("n").alias("in_language"))
    gid = F.when(F.col("n") >= LEAST, F.concat("l", F.lit("/"), "s")).when(F.col("pool") >= LEAST, F.concat("l", F.lit("/*"))).when(F.col("in_language") >= LEAST, F.col("l")).otherwise("*")
    groups = materialise(sizes.join(pooled, "l", "left").join(whole, "l").select("l", "s", gid.alias("gid")), "groups")
    # A row feeds its own group or pool, and the wider estimates that some group is judged by.
    feeds = groups.filter("gid like '%/%'").unionByName(sizes.join(groups.filter("gid = l").select("l", "gid").distinct(), "l").select("l", "s", "gid"))
    if not groups.filter("gid = '*'").isEmpty():
        feeds = feeds.unionByName(sizes.select("l", "s", F.lit("*").alias("gid")))
    vectors = [f"x{i}" for i in range(_P)]
    passing = rows.filter("not base_failed").select("l", "s", "salt", *vectors)
    sample = materialise(_beside(passing, feeds, ["l", "s"], few).select("gid", "salt", *vectors), "vectors")
    params = estimate(sample, few).drop("log_det")
    limit = chi2_quantile(1 - tail, _P)
    by_group = finished(groups.join(params, "gid").drop("gid"), "mcd-groups")
    far = F.when(~F.col("base_failed"), _distance())
    judged = _beside(rows, by_group, ["l", "s"], few, "left").withColumn("distance", far)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit))


def _measured(docs: DataFrame) -> DataFrame:
    """Statistics, group and vector of every row; of the other columns those that ``docs`` has beside ``text, lang, source``."""
    mark = lambda c: F.coalesce(F.hex(F.col(c).cast("string")), F.lit("-"))
    rest = [c for c in docs.columns if c not in ("text", "lang", "source")]
    return statistics(docs).select(
        *rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        mark("lang").alias("l"), mark("source").alias("s"), (F.monotonically_increasing_id() % SALTS).cast("int").alias("salt"), *[x.alias(f"x{i}") for i, x in enumerate(transformed())],
    )


def judge(docs: DataFrame, tail: float = TAIL, most_groups: int = MOST_GROUPS) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed``, ``kept`` and ``distance`` of every row."""
    source = text_columns(docs, "doc_id", "text", "lang", "source")
    with scratch(docs.sparkSession):
        rows = materialise(_measured(source), "statistics")
        with scratch(docs.sparkSession):
            found = _verdicts(rows, tail, most_groups)
        return finished(found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"), "verdicts")


def _identity() -> Column:
    """What tells rows apart: equal rows, and only those, get equal numbers (of 64 bits) and verdicts."""
    return F.xxhash64(*[F.coalesce(F.hex(F.col(c).cast("string")), F.lit("-")) for c in ("doc_id", "lang", "source")], F.coalesce("text", F.lit("")))


def keep_good(docs: DataFrame, tail: float = TAIL, most_groups: int = MOST_GROUPS, most_rejected: int = MOST_REJECTED) -> DataFrame:
    """The input's rows, all columns, without those that ``judge`` rejects.

    Up to ``most_rejected`` rejected rows are broadcast as numbers of 64 bits; beyond that both sides are shuffled by them.
    """
    source = text_columns(docs, "doc_id", "text", "lang", "source")
    with scratch(docs.sparkSession):
        rows = materialise(_measured(source.withColumn("row", _identity())), "statistics")
        with scratch(docs.sparkSession):
            found = _verdicts(rows, tail, most_groups)
        bad = finished(found.filter("not kept").select(F.col("row").alias("__gl_row")).distinct(), "rejected")
    few = bad.count() <= most_rejected
    return docs.withColumn("__gl_row", _identity()).join(F.broadcast(bad) if few else bad, "__gl_row", "left_anti").select(*docs.columns)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all documents."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
