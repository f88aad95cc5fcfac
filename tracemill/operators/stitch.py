"""Snapshots stitched into time series: linear and exponential fits, best fit, growth, short-term slope and anomalies.

A series table has keys, x (snapshot index from 0) and y. columns: how many snapshots there are, gaps included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOPE, ST_POINTS, ST_SLOPE, DEVIATION = 0.05, 5, 0.05, 2.0
TINY = 1e-100


def lines(series: DataFrame, keys: list[str], columns: int, st_points: int = ST_POINTS) -> DataFrame:
    """One row per key: fits and what is derived from them. Series without values are not there; fits need two points."""
    w = Window.partitionBy(*keys)
    two = F.count("y").over(w) >= 2
    x = series.where("y IS NOT NULL")
    x = x.withColumn("_b", F.when(two, F.regr_slope("y", "x").over(w))).withColumn("_a", F.when(two, F.regr_intercept("y", "x").over(w)))
    positive = F.min("y") > 0
    log = lambda f: F.when(positive & (F.count("y") >= 2), f(F.when(F.col("y") > 0, F.log("y")), F.col("x")))
    late = F.when(F.col("x") >= columns - st_points, F.col("y"))
    g = x.groupBy(*keys).agg(
        F.count("y").alias("num_filled"), F.avg("y").alias("avg"), F.first("_b").alias("slope"), F.first("_a").alias("intercept"),
        F.when(F.count("y") >= 2, F.coalesce(F.regr_r2("y", "x"), F.lit(1.0))).alias("r2"), F.avg(F.abs(F.col("y") - F.col("_a") - F.col("_b") * F.col("x"))).alias("l1"),
        F.exp(log(F.regr_intercept)).alias("exp_a"), F.exp(log(F.regr_slope)).alias("exp_b"), log(F.regr_r2).alias("exp_r2"),
        F.when((F.count(late) >= 2) & F.lit(columns >= 2 * st_points), F.regr_slope(late, F.col("x"))).alias("st_slope"),
        F.max(F.when(F.col("x") == columns - 1, F.col("y"))).alias("last"),
    )
    steps = columns - 1
    mid = F.col("intercept") + F.col("slope") * steps / 2
    growth = F.when(F.col("slope").isNotNull(), F.when(F.abs(mid) <= TINY, F.lit(0.0)).otherwise(F.col("slope") * steps / mid / (F.lit(steps) / 2.0)))
    scaled = lambda s: F.when(F.abs("avg") > TINY, s / (2 * F.col("avg")))
    last_at = F.col("intercept") + F.col("slope") * steps
    g = g.withColumn("lin_growth", growth).withColumn("exp_growth", F.col("exp_b") - 1)
    return g.withColumns({
        "best_fit": F.when(F.col("exp_r2").isNotNull() & (F.col("exp_r2") > F.col("r2")), "exponential").when(F.col("slope").isNotNull(), "linear").otherwise("none"),
        "scaled_slope": scaled(F.col("slope")), "scaled_st_slope": scaled(F.col("st_slope")),
        "last_deviation_scaled": F.when(F.abs("l1") > TINY, (F.col("last") - last_at) / F.col("l1")),
        "last_exp_deviation": F.col("last") - F.col("exp_a") * F.pow("exp_b", F.lit(float(steps))),
    }).withColumn("growth", F.when(F.col("best_fit") == "exponential", F.col("exp_growth")).otherwise(F.col("lin_growth")))


def anomalies(fitted: DataFrame, slope: float = SLOPE, st_slope: float = ST_SLOPE, deviation: float = DEVIATION) -> DataFrame:
    """Lines with a measure strictly above its bound; measures within bounds are null."""
    above = lambda c, bound: F.when(F.col(c) > bound, F.col(c)).alias(c)
    keys = [c for c in fitted.columns if c in ("key", "metric", "service", "operation")]
    out = fitted.where("slope IS NOT NULL").select(*keys, above("scaled_slope", slope), above("scaled_st_slope", st_slope), above("last_deviation_scaled", deviation))
    return out.where("scaled_slope IS NOT NULL OR scaled_st_slope IS NOT NULL OR last_deviation_scaled IS NOT NULL")


def drop_low_volume(service_counts: DataFrame, least: int) -> DataFrame:
    """service_counts: service, snapshot_id, num_received, num_unknown. Rows of services with more than `least` of both over all snapshots."""
    kept = service_counts.groupBy("service").agg(F.sum(F.col("num_received") + F.col("num_unknown")).alias("_n")).where(F.col("_n") > least).select("service")
    return service_counts.join(kept, "service", "left_semi")


def select_columns(series: DataFrame, chosen: list[int]) -> DataFrame:
    """The chosen snapshots, numbered anew from 0 without gaps."""
    new: Column = F.array_position(F.array(*[F.lit(c) for c in sorted(chosen)]), F.col("x")).cast("int") - 1
    return series.where(F.col("x").isin(chosen)).withColumn("x", new)


def ranked(items: DataFrame, rank: str, key: str) -> DataFrame:
    """Rank descending, then original order by key; idx from 1."""
    return items.withColumn("idx", F.row_number().over(Window.orderBy(F.col(rank).desc(), F.col(key))))


def lexicographic(items: DataFrame, key: str) -> DataFrame:
    idx = F.row_number().over(Window.orderBy(key))
    return items.withColumn("idx", idx).withColumn("rank", F.count("*").over(Window.partitionBy()) - idx + 1)
