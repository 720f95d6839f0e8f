"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakefold.llm.store import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge (columns a, b); component is the least node.

    Each round writes the contracted edges, so lineage stays short. Rounds grow with the logarithm
    of the longest chain. No node's neighbourhood is gathered in one task: only minima are.
    """
    current = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    seen = None
    while True:
        current = stored(_small_star(_large_star(current)), "edges")
        state = current.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == seen:
            break
        seen = state
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
