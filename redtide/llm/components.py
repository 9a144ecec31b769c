"""Connected components by alternating stars, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redtide.session import checkpointed


def _nearest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _nearest(both).withColumn("m", F.least("u", "m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = _nearest(edges)
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge up, to a node that has none; the edges are distinct."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.where("up > 1 or (up = 1 and down = 1)").agg(F.count("*")).first()[0]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of `edges` that isn't the least of its component.

    `a` and `b` are columns of one orderable type; loops, repeated and reversed edges are fine and
    null ends are left out. Each round halves distances, so the rounds grow with the logarithm of
    the longest chain; an earlier result, given as edges among others, counts as chains of one. Every round is
    checkpointed in the shared folder.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("a"), F.col(b).alias("b"))
    edges = checkpointed(ends.where("a <> b").select("u", "v").distinct())
    while not _settled(edges):
        edges = checkpointed(_small_star(_large_star(edges)))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
