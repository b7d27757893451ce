"""Connected components of an edge table, without bringing edges or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import new_dir, remove, stored


def _least(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour, or itself if that is less."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the component's least node.

    Alternates large-star and small-star steps: every node's greater neighbours, then all its lesser ones, are hung on
    its least neighbour.  The number of rounds grows with the logarithm of a component's diameter.  Partial
    aggregates come before each shuffle and the joins' hot sides can be split, so a star with very many rays is no
    hot task.  Each round is stored in the shared folder.  An empty table gives no rows; loops are ignored.
    """
    spark = edges.sparkSession
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), path := new_dir(spark, "edges"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = _least(large)
        small = large.join(least, "u").select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
        after = stored(small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), to := new_dir(spark, "edges"))
        # Both tables have no row twice, so they are equal if they are equally long and one lacks no row of the other.
        ended = after.count() == now.count() and after.join(now, ["u", "v"], "left_anti").isEmpty()
        remove(spark, path)
        now, path = after, to
        if ended:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
