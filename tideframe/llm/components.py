"""Connected components of a large graph by alternating large-star and small-star steps (Kiveris et al. 2014).

A step is two aggregations and a join over edges; no node's neighbours are ever gathered in one row, so a node with a
third of all edges is a skewed join key, which adaptive execution splits. Edges are settled in the shared folder after
each step, so lineage stays short and lost executors cost one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm import common


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that an edge a - b names; component is the smallest node reachable.

    Edges with a null end or from a node to itself are ignored; repeated edges count once; no edges give no rows.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = common.settle(now, "edges")
    was, figures = None, _figures(now)
    while figures != was and figures[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # kept before it is joined: a join of two plain shuffles can split a hot node, one of an aggregate cannot
        lowest = common.held(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.settle(large, "large-star")
        lowest.unpersist()
        lowest = common.held(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = common.settle(moved.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        lowest.unpersist()
        was, figures = figures, _figures(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _figures(edges: DataFrame) -> tuple:
    """Count and an exact order-free sum over the edges, equal only if they are the same (but for a chance of 2^-60)."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
