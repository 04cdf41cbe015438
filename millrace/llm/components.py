"""Connected components of an edge table, by alternating large and small stars.

Every round rewires each node to the smallest node it sees, first among all its
neighbours, then among the smaller ones, until every node has one root that has none
itself; stars are left. Rounds are joins and grouped minima over the edges, written to the shared
folder after each, so no component, however large, meets in one task or the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import pin


def _are_stars(edges: DataFrame) -> bool:
    """Has every node of the edges (a, b) one root that has none itself?"""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("child")).union(edges.select("b", F.lit(0)))
    seen = ends.groupBy("node").agg(F.sum("child").alias("roots"), F.min("child").alias("least"))
    return seen.where("roots > 1 OR (roots = 1 AND least = 0)").isEmpty()


def _stars(edges: DataFrame) -> DataFrame:
    """One round over edges (a, b) with a > b."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
    large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where("a != b").distinct()
    floor = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(floor, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(floor.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``; the root is its component's
    smallest node and is not listed itself. Loops and repeated or null edges do
    not matter; without edges the result is empty."""
    now = pin(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    while not _are_stars(now):
        now = pin(_stars(now), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
