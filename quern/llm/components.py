"""Connected components by repeated contraction, over written tables.

Each round, every node points to its smallest neighbour, pointers jump once, and the edges are contracted along them;
edges inside a contracted node vanish, so the work shrinks fast. Every step groups with an associative minimum, so a
node with a third of all edges is pre-aggregated before its shuffle; joins on nodes are left to adaptive
skew splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc", most_rounds: int = 60) -> DataFrame:
    """edges(a, b): long ids, any direction, repeats and loops allowed, nulls ignored.

    Returns (node, comp): each node that has an edge to another, with the smallest id reachable. Empty in, empty out.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges, labels = scratch.keep(edges.distinct(), f"{tag}-edges-0"), None
    for i in range(1, most_rounds + 1):
        ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = scratch.keep(ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), f"{tag}-point")
        up = point.select(F.col("node").alias("to"), F.col("to").alias("up"))
        jump = scratch.keep(point.join(up, "to").select("node", F.col("up").alias("comp")), f"{tag}-jump")
        at = lambda c, d: jump.select(F.col("node").alias(c), F.col("comp").alias(d))  # noqa: E731, B023
        nxt = edges.join(at("a", "ca"), "a").join(at("b", "cb"), "b").where("ca <> cb")
        nxt = nxt.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        if labels is None:
            labels = jump
        else:
            labels = labels.withColumnRenamed("comp", "old").join(at("old", "new"), "old", "left").select("node", F.coalesce("new", "old").alias("comp"))
        labels, edges = scratch.keep(labels, f"{tag}-{i}"), scratch.keep(nxt, f"{tag}-edges-{i}")
        scratch.drop(f"{tag}-{i - 1}", f"{tag}-edges-{i - 1}", f"{tag}-point", f"{tag}-jump")
        if not edges.limit(1).count():
            return labels
    raise RuntimeError("components did not settle")
