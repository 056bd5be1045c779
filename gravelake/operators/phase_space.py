"""Properties and links of halos in phase space."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravelake.operators.blocks import WIDTH, Meetings, in_blocks, meet
from gravelake.operators.neighbours import MOST_CELLS, pairs_within

#: Rows of a task of ``child_totals``.
ROWS = 1_000_000


def phase_space_links(members: DataFrame, by: str, link: float) -> DataFrame:
    """Pairs ``by, a, b`` of one group nearer than ``link`` in positions and velocities scaled by the group's dispersions.

    Cells are as wide as the link in scaled position, in blocks of each group;
    the velocity part of the distance is tested inside them.
    """
    axes, half = ("x", "y", "z", "vx", "vy", "vz"), MOST_CELLS // 2
    sd = members.groupBy(by).agg(F.sqrt((F.var_pop("x") + F.var_pop("y") + F.var_pop("z")) / 3).alias("sx"), F.sqrt((F.var_pop("vx") + F.var_pop("vy") + F.var_pop("vz")) / 3).alias("sv"))
    scaled = lambda c, s: F.col(c) / F.when(F.col(s) > 0, F.col(s)).otherwise(1)
    s = members.join(sd, by).select(by, "pid", *[scaled(c, "sx").alias(c) for c in "xyz"], *[scaled(f"v{c}", "sv").alias(f"v{c}") for c in "xyz"])
    # The cell of 0 is in the middle of a block; cells very far off come round, and the distance tells them apart.
    cells = tuple(F.pmod(F.floor(F.col(c) / link) + half + WIDTH // 2, F.lit(MOST_CELLS)) for c in "xyz")
    rows = in_blocks(s.filter(" and ".join(f"{c} is not null" for c in (by, "pid", *axes))), cells, F.lit(MOST_CELLS))

    def work(m: Meetings) -> Iterator[dict]:
        for part, left, right, d2, _ in m.distances(None):
            ok = np.flatnonzero(d2 < link * link)
            left, right, d2 = left[ok] + part.start, right[ok], d2[ok]
            for c in ("vx", "vy", "vz"):
                d = m.left[c][left] - m.right[c][right]
                d2 += d * d
            a, b = m.left["pid"][left], m.right["pid"][right]
            once = np.flatnonzero((d2 < link * link) & ((a < b) | ((a != b) & (m.left.cell[left] != m.right.cell[right]))))
            yield {by: m.left.take(by, left[once]), "a": np.minimum(a[once], b[once]), "b": np.maximum(a[once], b[once])}

    kind = lambda c: members.schema[c].dataType.simpleString()
    return meet(rows, work, f"{by} {kind(by)}, a {kind('pid')}, b {kind('pid')}", half=True, group=by)


def basic_properties(members: DataFrame, by: str) -> DataFrame:
    """Centre, mean motion with errors, radius and velocity dispersion."""
    n = F.count(F.lit(1))
    r2, v2 = F.var_pop("x") + F.var_pop("y") + F.var_pop("z"), F.var_pop("vx") + F.var_pop("vy") + F.var_pop("vz")
    return members.groupBy(by).agg(n.alias("n"), *[F.avg(c).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")], F.sqrt(r2 / n).alias("pos_error"), F.sqrt(v2 / n).alias("vel_error"), F.sqrt(r2).alias("r"), F.sqrt(v2).alias("vrms"))


def angular_momentum(members: DataFrame, by: str) -> DataFrame:
    """``jx, jy, jz``, kinetic energy and the spin of a virialised group: |J| sqrt(E) / (G M**2.5), with unit particle mass and G."""
    centre = members.groupBy(by).agg(*[F.avg(c).alias(f"c{c}") for c in ("x", "y", "z", "vx", "vy", "vz")])
    d = {c: F.col(c) - F.col(f"c{c}") for c in ("x", "y", "z", "vx", "vy", "vz")}
    j = (d["y"] * d["vz"] - d["z"] * d["vy"], d["z"] * d["vx"] - d["x"] * d["vz"], d["x"] * d["vy"] - d["y"] * d["vx"])
    out = members.join(centre, by).groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"j{c}") for c, v in zip("xyz", j, strict=True)], (0.5 * F.sum(d["vx"] * d["vx"] + d["vy"] * d["vy"] + d["vz"] * d["vz"])).alias("kinetic"))
    size = F.sqrt(F.col("jx") ** 2 + F.col("jy") ** 2 + F.col("jz") ** 2)
    return out.withColumn("spin", size * F.sqrt("kinetic") / F.pow(F.col("n").cast("double"), F.lit(2.5)))


def overdensity_masses(members: DataFrame, by: str, mean_density: float, thresholds: dict[str, float]) -> DataFrame:
    """For each threshold the number of members inside the largest sphere about the centre that is denser than threshold * mean."""
    from pyspark.sql import Window

    centre = members.groupBy(by).agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    r = F.sqrt(sum(((F.col(c) - F.col(f"c{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    ranked = members.join(centre, by).select(by, r.alias("r")).withColumn("m", F.row_number().over(Window.partitionBy(by).orderBy("r")))
    density = F.col("m") / (4 / 3 * math.pi * F.col("r") ** 3)
    return ranked.filter("r > 0").groupBy(by).agg(*[F.max(F.when(density > t * mean_density, F.col("m"))).alias(name) for name, t in thresholds.items()])


def grouped_potential(members: DataFrame, by: str, eps: float = 1e-6) -> DataFrame:
    """``by, pid, potential, kinetic, bound`` of every member, summed directly inside its group, block by block."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, v = pdf[["x", "y", "z"]].to_numpy(), pdf[["vx", "vy", "vz"]].to_numpy()
        v = v - v.mean(0)
        pe = np.zeros(len(x))
        for at in range(0, len(x), 256):
            d2 = ((x[at : at + 256, None, :] - x[None, :, :]) ** 2).sum(2)
            w = 1 / np.sqrt(d2 + eps * eps)
            w[np.arange(len(w)), at + np.arange(len(w))] = 0
            pe[at : at + 256] = w.sum(1)
        ke = 0.5 * (v**2).sum(1)
        return pd.DataFrame({by: pdf[by], "pid": pdf["pid"], "potential": pe, "kinetic": ke, "bound": pe >= ke})

    return members.select(by, "pid", "x", "y", "z", "vx", "vy", "vz").groupBy(by).applyInPandas(one, f"{by} bigint, pid bigint, potential double, kinetic double, bound boolean")


def shapes(members: DataFrame, by: str, rounds: int = 10) -> DataFrame:
    """Axis ratios ``b_to_a, c_to_a`` and the major axis, from the distance-weighted tensor iterated to its own ellipsoid."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[["x", "y", "z"]].to_numpy()
        x = x - x.mean(0)
        limit = (x**2).sum(1).max()
        axes, ratio, keep = np.eye(3), np.ones(3), np.ones(len(x), bool)
        for _ in range(rounds):
            e2 = ((x @ axes / ratio) ** 2).sum(1)
            keep = (e2 <= limit) & (e2 > 0)
            if keep.sum() < 4:
                break
            t = (x[keep, :, None] * x[keep, None, :] / e2[keep, None, None]).sum(0)
            w, axes = np.linalg.eigh(t)
            w, axes = np.maximum(w[::-1], 0), axes[:, ::-1]
            new = np.sqrt(w / w[0]) if w[0] > 0 else np.ones(3)
            done = np.abs(new - ratio).max() < 0.01
            ratio = np.maximum(new, 1e-3)
            if done:
                break
        return pd.DataFrame({by: [pdf[by].iloc[0]], "b_to_a": [ratio[1]], "c_to_a": [ratio[2]], **{f"a{c}": [axes[i, 0]] for i, c in enumerate("xyz")}})

    return members.select(by, "x", "y", "z").groupBy(by).applyInPandas(one, f"{by} bigint, b_to_a double, c_to_a double, ax double, ay double, az double")


def nfw_scale(members: DataFrame, by: str, bins: int = 50) -> DataFrame:
    """Scale radius of an NFW profile from counts in equal-number bins, by a search over concentrations."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[["x", "y", "z"]].to_numpy()
        r = np.sort(np.sqrt(((x - x.mean(0)) ** 2).sum(1)))
        rs = float("nan")
        if len(r) >= 10:
            outer = r[-1]
            edges = np.unique(np.concatenate([[0], r[np.linspace(0, len(r) - 1, min(bins, len(r) // 5) + 1).astype(int)[1:]]]))
            counts = np.histogram(r, edges)[0]
            c = np.exp(np.linspace(0, np.log(200), 400))
            mass = lambda s: np.log1p(s) - s / (1 + s)
            share = np.diff(mass(c[:, None] * edges[None, :] / outer), axis=1) / mass(c)[:, None]
            like = (counts[None, :] * np.log(np.maximum(share, 1e-300))).sum(1)
            rs = outer / c[like.argmax()]
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [len(r)], "rs": [rs]})

    return members.select(by, "x", "y", "z").groupBy(by).applyInPandas(one, f"{by} bigint, n bigint, rs double")


def child_totals(parents: DataFrame) -> DataFrame:
    """``id, total``: own count plus those of all descendants of a tree ``id, parent, n`` (null: a root); an error if there is a cycle.

    By pointer doubling: after r rounds a total covers the descendants fewer
    than 2**r steps below, and the pointer spans 2**r steps.
    """
    from gravelake.storage import stored

    given = parents.select("id", F.col("parent").alias("up"), F.col("n").alias("total"))
    unlisted = given.select(F.col("up").alias("id")).distinct().filter("id is not null").join(given, "id", "left_anti")
    now = stored(given.unionByName(unlisted, allowMissingColumns=True), "totals")
    most, span = now.count(), 1
    # Tasks of a bounded number of rows, however large the tree is; adaptive execution leaves a number that is given.
    parts = max(int(parents.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(most / ROWS))
    while not now.filter("up is not null").isEmpty():
        if span > most:
            raise ValueError("the parents form a cycle")
        below = now.filter("up is not null").select(F.col("up").alias("id"), "total").repartition(parts, "id").groupBy("id").agg(F.sum("total").alias("more"))
        ahead = now.select(F.col("id").alias("up"), F.col("up").alias("up2")).repartition(parts, "up")
        total = F.coalesce(F.col("total") + F.col("more"), "total", "more")
        totals = now.repartition(parts, "id").join(below, "id", "left").select("id", "up", total.alias("total"))
        now = stored(totals.repartition(parts, "up").join(ahead, "up", "left").select("id", F.col("up2").alias("up"), "total"), "totals")
        span *= 2
    return now.select("id", "total")


def closest_parents(halos: DataFrame, by: str, box: float, reach: float) -> DataFrame:
    """``id, host``: the larger halo of the same group that is nearest in position over radius and velocity over dispersion."""
    pairs = pairs_within(halos, halos, reach, box).filter((F.col("id") != F.col("r_id")) & (F.col(by) == F.col(f"r_{by}")) & (F.col("r_n") > F.col("n")))
    dv2 = sum(((F.col(f"v{c}") - F.col(f"r_v{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    metric = F.sqrt(F.col("d2") / (F.col("r_r") * F.col("r_r")) + dv2 / (F.col("r_vrms") * F.col("r_vrms")))
    return pairs.groupBy("id").agg(F.min(F.struct(metric.alias("m"), F.col("r_id").alias("h"))).alias("x")).select("id", F.col("x.h").alias("host"), F.col("x.m").alias("metric"))


def subhalo_profile(subhalos: DataFrame, hosts: DataFrame, bins: int = 10) -> DataFrame:
    """Mean and scatter of subhalo size and of the angle to the host's axis, by distance over host radius."""
    rows = subhalos.join(hosts.select(F.col("id").alias("host"), *[F.col(c).alias(f"h{c}") for c in "xyz"], F.col("r").alias("hr"), *[F.col(f"a{c}") for c in "xyz"]), "host")
    d = [F.col(c) - F.col(f"h{c}") for c in "xyz"]
    r = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    cos = F.abs(d[0] * F.col("ax") + d[1] * F.col("ay") + d[2] * F.col("az")) / r
    return rows.filter(r > 0).groupBy(F.least(F.floor(r / F.col("hr") * bins), F.lit(bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean_n"), F.stddev_pop("n").alias("sd_n"), F.avg(cos).alias("mean_cos"), F.stddev_pop(cos).alias("sd_cos"))
