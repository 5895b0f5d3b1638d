"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.tables import saved


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(pairs: DataFrame, keep: str) -> DataFrame:
    """Joins every kept neighbour of a node to the least of the node and all its neighbours."""
    least = saved(pairs.groupBy("a").agg(F.least("a", F.min("b")).alias("least")), "least")
    hung = pairs.where(keep).join(least, "a").select(F.col("least").alias("a"), "b")
    return hung.where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its least node) for every node of an edge.

    ``edges`` has long columns ``a``, ``b``; order, repeats, loops and nulls do
    not matter. Nodes without an edge to another are left out. Rounds of two
    steps hang all larger neighbours, then all smaller ones, of each node on the
    least neighbour, until every component is one star; their number grows with
    the logarithm of the largest component's size. Each round is written to the
    shared folder, and only a count and a sum per round go to the driver. The
    least neighbour is found by partial minima and written, so that the join back
    to it, on partitions of its own, can split a node with very many edges.
    """
    clean = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now, mark = saved(clean, "stars"), None
    while True:
        large = saved(_star(_both_ways(now), "b > a").distinct(), "stars")
        # Smaller neighbours of b, and b itself, hang on the least of them.
        turned = large.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = saved(turned.groupBy("a").agg(F.min("b").alias("least")), "least")
        small = turned.join(least, "a").select(F.col("least").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        now = saved(small.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "stars")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
                now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            )
        mark = tuple(seen)
