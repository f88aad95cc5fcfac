"""Connected components of an edge table, by alternating large-star and small-star steps. Nothing is collected.

Joins are between plain tables, so Spark can split the neighbours of a hot node over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _least(e: DataFrame) -> DataFrame:
    """node, m: the smallest neighbour of each node that has a smaller one."""
    return stored(e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, a <> b). Returns node, component (the smallest node reachable); nodes without edges are not listed."""
    e = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    while True:
        least = _least(e)
        x = e.join(least, e["a"] == least["node"], "left")
        large = stored(x.select(F.coalesce("m", "a").alias("a"), "b").distinct())  # what is larger than a goes to the smallest beside a
        low = _least(large)
        y = large.join(low, large["b"] == low["node"])
        small = y.where("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(low.select(F.col("m").alias("x"), F.col("node").alias("y")))
        last, e = e, stored(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        discard(last, least, large, low)
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        mark = seen
