"""Connected components of an edge list by alternating large-star and small-star steps.

Each step is a minimum per node (combined before the shuffle) and a join; no
node's neighbours are gathered. Edges become stars around the smallest node of
each component in a logarithmic number of rounds. Every round is written to
the shared folder and the one before it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import Durable


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, scratch: Durable) -> DataFrame:
    """(node, component): every node of an edge (u, v) but the smallest of its component, and that smallest."""
    edges = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, seen = scratch.keep(edges), None
    while True:
        # both steps leave u > v, and equal sums of hashes mean that nothing moved
        moved = scratch.keep(_small_star(_large_star(edges).distinct()).distinct())
        scratch.drop(edges)
        edges = moved
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
