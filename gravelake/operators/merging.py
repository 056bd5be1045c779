"""Matching halos between epochs and cleaning catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gravelake.storage import stored

#: Fixed values of the matching: share of a candidate that must be recovered, smallest halo, tags, particles left.
SHARE, MIN_SIZE, MIN_TAGGED, LOWEST = 0.49, 50, 5, 2
#: Candidates whose sizes are broadcast at most.
FEW = 20_000


def associations(earlier: DataFrame, later: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """``halo, prog, n, rho, dist`` of particles that a halo shares with candidates near it; without ``near`` all candidates, without ``dist``.

    ``earlier``: ``prog, pid``; ``later``: ``halo, pid, rho``; ``near``: ``halo, prog, dist``.
    Shared particles are dealt by halo, where what follows needs them.
    """
    shared = later.join(earlier, "pid").repartition("halo").groupBy("halo", "prog").agg(F.count(F.lit(1)).alias("n"), F.sum("rho").alias("rho"))
    return shared if near is None else shared.join(near, ["halo", "prog"])


def claimed_progenitors(shared: DataFrame, lowest: int = LOWEST) -> DataFrame:
    """``halo, main_prog, n_prog, main_weight``: candidates claim shared particles in order of distance.

    Candidates are ignored once fewer than ``lowest`` particles are left.  Since
    halos of one epoch share no particle, an earlier claim takes nothing from a
    later one, and what is left before each is a running sum.
    """
    order = Window.partitionBy("halo").orderBy("dist", "prog").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy("halo"))
    live = shared.withColumn("left", total - F.coalesce(F.sum("n").over(order), F.lit(0))).filter(F.col("left") >= lowest)
    best = F.max(F.struct("rho", (-F.col("dist")).alias("d"), (-F.col("prog")).alias("p"))).alias("x")
    return live.groupBy("halo").agg(best, F.count(F.lit(1)).alias("n_prog")).select("halo", (-F.col("x.p")).alias("main_prog"), "n_prog", F.col("x.rho").alias("main_weight"))


def progenitor_lists(shared: DataFrame, sizes: DataFrame, lowest: int = LOWEST, share: float = SHARE) -> DataFrame:
    """``halo, progenitors, main_prog, main_frac, is_split``: candidates of which ``share`` was recovered.

    ``sizes``: ``prog, n_tagged``.  A main progenitor outside the list marks a potential split.
    """
    order = Window.partitionBy("halo").orderBy("dist", "prog").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy("halo"))
    live = shared.withColumn("left", total - F.coalesce(F.sum("n").over(order), F.lit(0))).filter(F.col("left") >= lowest)
    sizes = stored(sizes.filter(F.col("n_tagged") > lowest), "sizes")
    few = F.broadcast(sizes) if sizes.count() <= FEW else sizes  # checked: rows that are dealt by halo stay where they are
    rows = live.join(few, "prog").withColumn("frac", F.col("n") / F.col("n_tagged"))
    best = F.max(F.struct("rho", (-F.col("dist")).alias("d"), (-F.col("prog")).alias("p"), "frac")).alias("x")
    out = rows.groupBy("halo").agg(F.sort_array(F.collect_list(F.when(F.col("frac") >= share, F.col("prog")))).alias("progenitors"), best)
    main = -F.col("x.p")
    return out.select("halo", "progenitors", main.alias("main_prog"), F.col("x.frac").alias("main_frac"), (~F.array_contains("progenitors", main)).alias("is_split"))


def with_sentinels(associated: DataFrame, halos: DataFrame) -> DataFrame:
    """Every halo, with -999 and the list [0] where nothing was found."""
    return halos.join(associated, "halo", "left").select("halo", F.coalesce("progenitors", F.array(F.lit(0).cast("long"))).alias("progenitors"), F.coalesce("main_prog", F.lit(-999)).alias("main_prog"), F.coalesce("main_frac", F.lit(0.0)).alias("main_frac"), F.coalesce("is_split", F.lit(False)).alias("is_split"))


def main_branches(snapshots: list[DataFrame]) -> DataFrame:
    """``id, snap, branch_id, n, peak_n, peak_snap``: branches followed back through ``snapshots`` (latest first; ``id, n, main_prog``).

    As many joins as snapshots; each is an equality join on the progenitor.
    """
    first = snapshots[0]
    walk = first.select(F.col("id").alias("branch"), F.lit(0).alias("snap"), "id", "n", "main_prog")
    parts = [walk]
    for k, snap in enumerate(snapshots[1:], 1):
        back = walk.select("branch", F.col("main_prog").alias("id")).filter("id >= 0")
        walk = back.join(snap.select("id", "n", "main_prog"), "id").select("branch", F.lit(k).alias("snap"), "id", "n", "main_prog")
        parts.append(walk)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    back_in_time = Window.partitionBy("branch").orderBy(F.desc("snap")).rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumns({"peak_n": F.max("n").over(back_in_time), "peak_snap": F.max_by("snap", "n").over(back_in_time)})


def needs_cleaning(branches: DataFrame, factor: float = 2.0) -> DataFrame:
    """Branches whose earlier peak exceeds today's size by ``factor`` and that shrank since."""
    now = branches.filter("snap = 0").select("branch", F.col("id"), F.col("n").alias("n_now"))
    peak = branches.groupBy("branch").agg(F.max("n").alias("n_peak"), F.max_by("snap", "n").alias("snap_peak"), F.max_by("id", "n").alias("id_peak"))
    return now.join(peak, "branch").filter((F.col("n_peak") >= factor * F.col("n_now")) & (F.col("snap_peak") > 0))


def eligible(halos: DataFrame, size: str = "n", tagged: str = "n_tagged") -> DataFrame:
    """Halos large enough to be matched."""
    return halos.filter((F.col(size) >= MIN_SIZE) & (F.col(tagged) >= MIN_TAGGED))


def merge_targets(cleaned: DataFrame, near: DataFrame, peaks: DataFrame) -> DataFrame:
    """``id, target`` of cleaned halos.

    Of the neighbours with the same peak progenitor, the halo itself among
    them, the most massive is the target, unless it is the halo itself.  Then
    the neighbours are gone through in order, and the first one counts that is
    another halo and lists the halo's own main progenitor, or that is the most
    massive of all and at least as massive as what the halo lost.

    ``cleaned``: ``id, id_peak, main_prog, lost``; ``near``: ``id, other, place``
    (the halo itself included); ``peaks``: ``other, mass, other_peak, progenitors``.
    """
    return chosen_targets(cleaned.join(near, "id").join(peaks, "other"), ["place"], ["id"])


def chosen_targets(rows: DataFrame, place: list[str], by: list[str]) -> DataFrame:
    """``id, target`` from rows that have what ``merge_targets`` joins; ``place``: numbers that order a halo's neighbours.

    ``by`` ends with ``id``; keys before it, by which rows are dealt already, save their shuffle.
    """
    back = F.struct(*[(-F.col(c)).alias(c) for c in place])
    first = F.struct("mass", back.alias("p"), "other")
    same = F.max(F.when(F.col("other_peak") == F.col("id_peak"), first)).alias("same")
    lists = (F.col("other") != F.col("id")) & F.array_contains("progenitors", F.col("main_prog"))
    by_list = F.max(F.when(lists, F.struct(back.alias("p"), "other"))).alias("by_list")
    found = rows.groupBy(*by).agg(same, by_list, F.max(first).alias("top"), F.first("lost").alias("lost"))
    by_mass = F.when(F.col("top.mass") >= F.col("lost"), F.struct(F.col("top.p").alias("p"), F.col("top.other").alias("other")))
    other = F.greatest("by_list", by_mass)["other"]  # the one that comes first; nulls are skipped
    return found.select("id", F.when(F.col("same.other") != F.col("id"), F.col("same.other")).otherwise(other).alias("target")).filter("target is not null")


def merged_particles(lists: DataFrame, members: DataFrame) -> DataFrame:
    """Particle ranges of merged halos put after each other in their hosts.

    ``lists``: ``halo, start, count``; ``members``: ``host, halo``.  Returns
    ``host, halo, start, count, new_start`` with ``new_start`` inside the host.
    """
    order = Window.partitionBy("host").orderBy("halo").rowsBetween(Window.unboundedPreceding, -1)
    return members.join(lists, "halo").withColumn("new_start", F.coalesce(F.sum("count").over(order), F.lit(0)).cast("long"))
