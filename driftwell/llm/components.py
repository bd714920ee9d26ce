"""Connected components of an edge list, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node of ``edges`` (``a, b``, both
    not null; order, repeats and loops don't matter).

    Each round links every neighbour of a node to the smallest one around: first the larger
    neighbours, then the node and its smaller ones. Both are a minimum per node, which Spark adds
    up before the shuffle, and a join back, so a node with very many edges is no group of its own.
    The rounds grow with the logarithm of the longest path. Edges are written between rounds.
    """
    now = stored(_both(edges).where("a > b").distinct(), "edges")
    state = _state(now)
    while True:
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        larger = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(larger.where("a > b").distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        smaller = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        following = stored(smaller.where("a > b").distinct(), "edges")
        then = _state(following)
        now = following
        if then == state:
            break
        state = then
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes: equal after a round that changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
