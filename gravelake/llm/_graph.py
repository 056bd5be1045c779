"""Connected components of an edge list, in joins and aggregates only.

Nodes are relabelled by a bijective hash, so that hooking every node to its
smallest neighbour gives shallow trees; after pointer jumps the edges are
contracted onto the roots.  Rounds grow with the logarithm of the nodes.  Every
round's tables are written to the shared folder, which bounds the lineage and
leaves plain scans below the joins, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialise

JUMPS = 3


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``node, label`` for every node that edges ``a, b`` touch (and every node of ``labels``); equal labels: one component.

    ``labels`` are those of an earlier call, to which ``edges`` are added.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    if labels is not None:
        fresh = nodes.join(labels, "node", "left_anti").select("node", F.xxhash64("node").alias("label"))
        labels = materialise(labels.unionByName(fresh), "labels")
    else:
        labels = materialise(nodes.select("node", F.xxhash64("node").alias("label")), "labels")
    known = labels.select(F.col("node"), F.col("label"))
    mapped = (
        edges.join(known.withColumnsRenamed({"node": "a", "label": "la"}), "a")
        .join(known.withColumnsRenamed({"node": "b", "label": "lb"}), "b")
        .select(F.col("la").alias("a"), F.col("lb").alias("b"))
    )
    links = materialise(mapped.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        roots = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("p")), "hooks")
        for _ in range(JUMPS):
            up = roots.select(F.col("u").alias("p"), F.col("p").alias("q"))
            roots = materialise(roots.join(up, "p").select("u", F.col("q").alias("p")), "jumps")
        labels = materialise(labels.join(roots.withColumnRenamed("u", "label"), "label", "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        links = materialise(
            links.join(roots.withColumnsRenamed({"u": "a", "p": "pa"}), "a")
            .join(roots.withColumnsRenamed({"u": "b", "p": "pb"}), "b")
            .filter("pa != pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(),
            "links",
        )
    return labels
