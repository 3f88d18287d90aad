"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlake.llm.tables import drop, materialize


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every upper end has one edge, and no lower end is an upper end."""
    uppers = edges.groupBy("u").agg(F.count("*").alias("n"))
    if uppers.where("n > 1").limit(1).count():
        return False
    return not edges.join(uppers.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for each node with an edge to another, the smallest node it is connected to.

    Each step replaces edges by edges to the smallest known neighbour (Kiveris et al., "Connected
    Components in MapReduce and Beyond", 2014); a node's neighbours are only ever aggregated, never
    gathered, and minima are written, so that a join on a busy node can be split.
    """
    now = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges"
    )
    while not _is_forest_of_stars(now):
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        lowest = materialize(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "large-star")
        large = both.where("y > x").join(lowest, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, "large-edges")
        lower = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        after = materialize(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for table in (now, lowest, large, lower):
            drop(table)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
