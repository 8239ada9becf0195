"""Connected components by alternating large and small stars, native and free of hot spots.

Each step takes minima per node (combined before the shuffle) and joins them back, which adaptive
execution splits where a node is hot; the edges are written after each step, and as many tasks are used as they
need. The steps grow with the logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop, partitions

ROWS_A_TASK = 100_000


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Large: each node's larger neighbours go to the least node of its neighbourhood; small: its smaller ones and itself do."""
    ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = ways.join(least, "u")
    out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).coalesce(tasks).distinct().coalesce(tasks)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component (the least node reachable) for every node with an edge; u and v: any type with an order."""
    edges = cut(edges.select("u", "v").filter(F.col("u") != F.col("v")))
    for _ in range(most):
        tasks = min(partitions(edges.sparkSession), edges.count() // ROWS_A_TASK + 1)
        after = cut(_star(_star(edges.coalesce(tasks), True, tasks), False, tasks))
        drop(edges)
        edges = after
        onward = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").coalesce(tasks).select("u")
        torn = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").coalesce(tasks).select("u")
        if not onward.unionByName(torn).agg(F.count("*")).first()[0]:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
