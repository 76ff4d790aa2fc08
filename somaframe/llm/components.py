"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.writers import staged

ROUNDS = 60


def _contracted(edges: DataFrame) -> bool:
    """Whether the links (distinct) are stars already: a node has one smaller
    neighbour at most, and that has none."""
    ends = edges.select(F.col("high").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("low", F.lit(0), F.lit(1)))
    open_ = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1")
    return open_.limit(1).count() == 0


def components(links: DataFrame) -> DataFrame:
    """node and component, the smallest node reachable, for all nodes of ``links``
    (columns a, b). Alternates two contractions: each node hands its larger
    neighbours, then its smaller ones, to its smallest neighbour. The links become
    stars in a number of rounds that grows with the logarithm of the path length.
    A round is written out, so a lost executor costs a re-read; links that are stars
    take none."""
    edges = staged(
        links.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "links")
    for _ in range(ROUNDS):
        if _contracted(edges):
            break
        both = edges.select(F.col("high").alias("x"), F.col("low").alias("y")).union(edges.select("low", "high"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        outward = both.join(least, "x").filter("y > x").select(F.col("y").alias("high"), F.col("m").alias("low")).distinct()
        root = outward.groupBy("high").agg(F.min("low").alias("m"))
        inward = outward.join(root, "high").select(
            F.explode(F.array(
                F.struct(F.col("high"), F.col("m").alias("low")),
                F.struct(F.col("low").alias("high"), F.col("m").alias("low")),
            )).alias("e")).select("e.*").filter("high > low").distinct()
        edges = staged(inward, "links")
    else:
        raise RuntimeError(f"links not contracted after {ROUNDS} rounds")
    nodes = edges.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return nodes.union(edges.select("low", "low")).distinct()
