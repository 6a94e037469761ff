"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polynya.llm.base import forget, written


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Node and smaller neighbours are linked to the smallest of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    below = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return below.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of an edge list ``a, b`` of longs; root is the smallest node.

    Each round is written to the shared folder, so neither the plan nor a lost executor
    brings earlier rounds back. Nodes without an edge to another node are not listed.
    """

    def tidy(df: DataFrame) -> DataFrame:
        ends = df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        return written(ends.where("a <> b").distinct(), "star")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = tidy(edges)
    before = mark(edges)
    while before[0]:
        large = tidy(_large(edges))
        forget(edges)
        edges = tidy(_small(large))
        forget(large)
        now = mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
