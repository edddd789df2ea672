"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a, b), a < b: each node's larger neighbours, then the others, move to its smallest one."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
    parents = large.groupBy("b").agg(F.min("a").alias("m"))
    moved = large.join(parents, "b").select("m", F.col("a").alias("v")).where("m < v")
    return moved.select(F.col("m").alias("a"), F.col("v").alias("b")).union(parents.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for all nodes of links (a, b); the root is a component's smallest node. No links, no rows.

    The number of rounds grows with the logarithm of the number of nodes. Each round is written to the shared folder. Nodes
    with very many links are aggregated before the shuffle; their joins are split where adaptive execution finds skew.
    """
    edges = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "stars")
    mark = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if state == mark or state["n"] == 0:
            break
        mark = state
        edges = materialise(_stars(edges), "stars")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
