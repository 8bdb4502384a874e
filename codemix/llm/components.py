"""Connected components of a graph given by its links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codemix.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least one."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the least node.

    Each round is a few joins on nodes whose result goes to the shared folder. The
    number of rounds grows with the logarithm of the longest path; hubs are rows of
    an inner join, which adaptive execution splits. Links to null or to oneself
    count as none; repeated links and either direction are the same.
    """
    links = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = written(links.distinct(), "links")
    state = None
    for _ in range(rounds):
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        links = written(_small_star(_large_star(links).distinct()).distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
