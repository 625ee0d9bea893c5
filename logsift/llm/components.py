"""Connected components of a table of links by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.sources.storage import saved


def _lowest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the lowest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are linked to the lowest of them."""
    low = _lowest(edges)
    hung = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(low.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (u, v): root is the lowest node it is linked to, itself included.

    The number of rounds grows with the logarithm of the longest path. Each round
    ends in a reliable checkpoint, so that a lost executor costs one round at most.
    No group is gathered: minima are combined map-side, and the joins' hot nodes
    are split by Spark. No links give no rows; self-links and repeats do no harm.
    """
    edges = saved(
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        edges = saved(_small_star(_large_star(edges).distinct()).filter("u <> v").distinct())
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(leaves.select("root", "root").distinct())
