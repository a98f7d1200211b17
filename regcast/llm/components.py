"""Connected components by alternating large-star and small-star steps (joins and aggregates only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regcast.session import materialize


def _is_star_forest(e: DataFrame) -> bool:
    """Every node has one parent at most, and no parent has a parent."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(e.select("v", F.lit(0), F.lit(1)))
    node = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return node.filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v): every node that is not the least of its component, with that least node.

    ``edges`` has two long columns u and v in any direction; loops and repeats
    are harmless, rows with a null are left out. Each round links every node's
    larger neighbours, then its smaller ones, to its least neighbour, and ends
    in a checkpoint; rounds grow with the logarithm of the longest chain. No
    neighbour list is ever gathered, so a hub of any degree is only a hot join
    key, which adaptive execution splits.
    """
    a, b = F.col("u"), F.col("v")
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct())
    while not _is_star_forest(e):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = e.join(least, F.col("v") == F.col("w")).select("u", F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        e = materialize(small.filter("u != v").distinct())
    return e
