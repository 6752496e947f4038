"""Connected components by alternating large-star and small-star steps, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_anew


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: longs, or binaries) -> node, component: the smallest node that it is connected with, for each node
    of an edge. Loops and repeated edges do no harm; nulls are ignored; no edges: no rows.

    Each half step moves every node's edges to the least of its neighbours. The minimum is aggregated before the
    shuffle, and a node with very many neighbours only makes a large partition of one side of a join, which adaptive
    execution splits. Every round is cut off from the last by checkpoint(); each but the last moves an edge to a
    smaller node, so the rounds end, when all edges are rays of stars whose middle is their smallest node.
    """
    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct().checkpoint()
    while not _stars(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = join_anew(both.where("b > a"), least, ["a"]).select(F.col("m").alias("a"), "b").where("a < b")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        pairs = join_anew(large, least, ["b"])
        small = pairs.select(F.col("m").alias("a"), F.col("b")).union(pairs.select(F.col("m").alias("a"), F.col("a").alias("b")))
        now = small.where("a < b").distinct().checkpoint()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """No node has two smaller neighbours, or both a smaller and a larger one."""
    ends = edges.select(F.col("a").alias("n"), F.lit(0).alias("up")).union(edges.select(F.col("b").alias("n"), F.lit(1).alias("up")))
    counted = ends.groupBy("n").agg(F.sum("up").alias("up"), F.count("*").alias("all"))
    return counted.where("up > 1 OR (up = 1 AND all > 1)").isEmpty()
