"""The columns of a halo catalogue about two centres: the halo's own and that of its largest subhalo.

Fixed values of the format: ratios are stored in units of 1/32000; the five
largest subhalos are listed; second moments are of members nearer than r90,
divided by size * 9 // 10.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gravelake.functions.geometry import eigensystem
from gravelake.functions.triads import pack_triad
from gravelake.operators.halos import RANKS, RATIO

LARGEST = 5
_TENSORS = ("v", "r", "n")
_PARTS = ("xx", "yy", "zz", "xy", "xz", "yz")


def _as_ratio(x: Column) -> Column:
    return F.round(x * RATIO).cast("int")


def _moments(rows: DataFrame, by: str) -> DataFrame:
    """Rank radii and moments of rows ``by, n, dx .. , dvx ..`` relative to a centre, one row for each halo."""
    d2 = sum((F.col(f"d{c}") * F.col(f"d{c}") for c in "xyz"), F.lit(0.0))
    v2 = sum((F.col(f"dv{c}") * F.col(f"dv{c}") for c in "xyz"), F.lit(0.0))
    rows = rows.withColumns({"d2": d2, "v2": v2})
    ranked = rows.withColumn("p", F.row_number().over(Window.partitionBy(by).orderBy("d2")) - 1)
    curve = F.when(F.expr("p >= case when n < 1000 then n div 10 else 100 end and d2 > 0"), F.struct((F.col("p").cast("double") * F.col("p") / F.col("d2")).alias("v4"), (-F.col("d2")).alias("m")))
    # In the same pass: distances computed anew would differ in the last bit from the radius that they are compared with.
    group = Window.partitionBy(by)
    at = {f"q_{name}": F.max(F.expr(f"case when p = n * {p} div {q} then d2 end")).over(group) for name, (p, q) in RANKS.items()}
    joined = ranked.withColumns({"q_r100": F.max("d2").over(group), **at, "curve": curve})
    inside, half = F.col("d2") < F.col("q_r90"), F.col("d2") < F.col("q_r50")
    unit = {c: F.col(f"d{c}") / F.sqrt(F.col("d2") + 1e-20) for c in "xyz"}
    along = sum((F.col(f"dv{c}") * unit[c] for c in "xyz"), F.lit(0.0))
    vector = {"v": {c: F.col(f"dv{c}") for c in "xyz"}, "r": {c: F.col(f"d{c}") for c in "xyz"}, "n": unit}
    share = lambda value, where, over: F.sum(F.when(where, value).otherwise(F.lit(0.0))) / F.expr(f"max(n) {over}")
    sums = [share(vector[t][p[0]] * vector[t][p[1]], inside, "* 9 div 10").alias(f"{t}{p}") for t in _TENSORS for p in _PARTS]
    sums += [share(along * along, inside, "* 9 div 10").alias("vrr"), (share(F.col("v2") - along * along, inside, "* 9 div 10") / 2).alias("vtt"), share(F.sqrt("v2"), inside, "* 9 div 10").alias("speed")]
    sums += [share(F.sqrt("v2"), half, "div 2").alias("speed_r50"), share(F.col("v2"), half, "div 2").alias("square_r50")]
    return joined.groupBy(by).agg(*sums, F.max("curve").alias("curve"), *[F.first(c).alias(c) for c in ("q_r100", *at)])


def about_centre(rows: DataFrame, by: str, suffix: str) -> DataFrame:
    """A catalogue's columns about one centre, named with ``suffix``."""
    out = _moments(rows, by)
    for t in _TENSORS:
        out = eigensystem(out, tuple(f"{t}{p}" for p in _PARTS))
        out = out.withColumnsRenamed({f"e{i}": f"{t}_e{i}" for i in (1, 2, 3)} | {f"v{i}{k}": f"{t}_v{i}{k}" for i in (1, 2, 3) for k in (1, 2, 3)})
        out = out.withColumn(f"{t}_code", pack_triad(*[F.coalesce(f"{t}_v{i}{k}", F.lit(0.0)) for i in (1, 3) for k in (1, 2, 3)]))
    r100, sigma = F.sqrt("q_r100"), F.sqrt(F.col("vxx") + F.col("vyy") + F.col("vzz"))
    root = lambda c: F.sqrt(F.greatest(F.col(c), F.lit(0.0)))
    over = lambda a, b: _as_ratio(F.when(b > 0, a / b).otherwise(F.lit(0.0)))
    named = {
        "sigmav3d": sigma, "meanSpeed": F.col("speed"), "sigmav3d_r50": F.col("square_r50"), "meanSpeed_r50": F.col("speed_r50"), "r100": r100,
        "vcirc_max": F.sqrt(F.sqrt(F.coalesce("curve.v4", F.lit(0.0)))), "rvcirc_max": over(F.sqrt(-F.coalesce("curve.m", F.lit(0.0))), r100),
        "sigmavMin_to_sigmav3d": over(root("v_e3"), sigma), "sigmavMax_to_sigmav3d": over(root("v_e1"), sigma), "sigmavrad_to_sigmav3d": over(root("vrr"), sigma), "sigmavtan_to_sigmav3d": over(root("vtt"), sigma),
        **{name: over(F.sqrt(f"q_{name}"), r100) for name in RANKS},
        "sigmar": F.array(*[over(root(f"r_e{i}"), r100) for i in (1, 2, 3)]), "sigman": F.array(*[_as_ratio(root(f"n_e{i}")) for i in (1, 2, 3)]),
        "sigmav_eigenvecs": F.col("v_code"), "sigmar_eigenvecs": F.col("r_code"), "sigman_eigenvecs": F.col("n_code"),
    }
    return out.select(by, *[c.alias(f"{name}_{suffix}") for name, c in named.items()])


def halo_outputs(members: DataFrame, by: str, sub: str = "l2", parents: DataFrame | None = None) -> DataFrame:
    """Every halo's catalogue row from members ``by, sub, x, y, z, vx, vy, vz, density``.

    ``sub`` numbers the subhalos (null: in none).  The largest one, the smaller
    number on ties, is the second centre; a halo without any uses all members.
    ``parents``: ``by, l0_n``.  The densest member is the central particle, and
    the radius reaches to the member farthest from it.
    """
    axes = ("x", "y", "z", "vx", "vy", "vz")
    counts = members.groupBy(by, sub).agg(F.count(F.lit(1)).alias("m"))
    subs = counts.filter(F.col(sub).isNotNull()).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("m", (-F.col(sub)).alias("i"))), asc=False).alias("list"))
    sizes = F.slice(F.transform("list", lambda x: x["m"]), 1, LARGEST)
    subs = subs.select(by, F.concat(sizes, F.array_repeat(F.lit(0).cast("long"), LARGEST - F.size(sizes))).alias("L2_N"), (-F.element_at("list", 1)["i"]).alias("largest"))
    tagged = members.join(subs, by, "left").withColumn("core", F.coalesce(F.col(sub) == F.col("largest"), F.col("largest").isNull()))
    core = lambda c: F.when(F.col("core"), F.col(c))
    place = F.struct(*[F.col(c).alias(c) for c in "xyz"])
    centres = tagged.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.first("L2_N").alias("L2_N"), *[F.avg(c).alias(f"{c}_com") for c in axes], *[F.avg(core(c)).alias(f"{c}_L2com") for c in axes],
        F.max_by(place, "density").alias("SO_central_particle"), F.max("density").alias("SO_central_density"), F.max_by(F.when(F.col("core"), place), core("density")).alias("SO_L2max_central_particle"), F.max(core("density")).alias("SO_L2max_central_density"),
    )
    rows = tagged.join(centres.drop("L2_N"), by)
    away = lambda p: F.sqrt(sum(((F.col(c) - F.col(f"{p}.{c}")) * (F.col(c) - F.col(f"{p}.{c}")) for c in "xyz"), F.lit(0.0)))
    radii = rows.groupBy(by).agg(F.max(away("SO_central_particle")).alias("SO_radius"), F.max(F.when(F.col("core"), away("SO_L2max_central_particle"))).alias("SO_L2max_radius"))
    out = centres.join(radii, by)
    for suffix in ("com", "L2com"):
        shifted = rows.select(by, "n", *[(F.col(c) - F.col(f"{c}_{suffix}")).alias(f"d{c}") for c in axes])
        out = out.join(about_centre(shifted, by, suffix), by)
    out = out.withColumn("L2_N", F.coalesce("L2_N", F.array_repeat(F.lit(0).cast("long"), LARGEST))).withColumnRenamed("n", "N")
    return out if parents is None else out.join(parents, by, "left")
