"""Connected components of a large edge list: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.session import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour ``a`` of a node ``b`` moves to the smallest node around ``b``, which a smaller one of its own tells."""
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    return edges.join(least, F.col("b") == F.col("node"), "left").select("a", F.coalesce("m", "b").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has one only and is nobody's smaller neighbour."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 and up > 0").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node with an edge.

    Each round writes its edges ``a > b`` to the shared folder; the rounds end when all of them are stars.
    """
    ends = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = settle(ends.distinct(), "edges")
    while not _are_stars(edges):
        edges = settle(_small_star(_large_star(edges)), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
