"""Order statistics of durations (µs) in milliseconds, and rates of start times.

Both come from histograms that are pre-aggregated by value, cut into buckets of values: ranks are sums over buckets plus ranks
within one, so no task holds a key's values in memory and a hot key is spread over its buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PERCENTILES = (0.75, 0.9, 0.95, 0.99)
#: Bits of a bucket of values: 65 ms of durations.
BUCKET_BITS = 16


#: Bytes of a stored table that a task takes, some 200,000 to 300,000 spans.
TASK_BYTES = 4 << 20


def dealt(df: DataFrame, *keys: str, of: DataFrame | None = None) -> DataFrame:
    """df dealt out by keys, to spark.sql.shuffle.partitions, or to more where `of` (df) is read from a table of more than so many TASK_BYTES: what a task
    holds doesn't grow with the table."""
    leaves = (of or df)._jdf.queryExecution().optimizedPlan().collectLeaves()
    if leaves.size() == 1 and leaves.apply(0).getClass().getSimpleName() == "LogicalRelation":
        n = -(-leaves.apply(0).stats().sizeInBytes() // TASK_BYTES)
        if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            return df.repartition(n, *keys)
    return df.repartition(*keys)


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a joined with b on keys, where null equals null; b's keys are dropped."""
    b = b.withColumnsRenamed({k: f"_j_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys])
    return a.join(b, on).drop(*[f"_j_{k}" for k in keys])


def _filled(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with its keys as _k_ columns without nulls, and _nulls, a bit for each null: joins on them are of equal values, so they use the partitions of
    what was dealt out by them. Those of eqNullSafe don't."""
    empty = lambda k: F.lit("").cast(k.dataType) if isinstance(k.dataType, StringType) else F.lit(0).cast(k.dataType)
    kinds = [df.schema[k] for k in keys]
    nulls = reduce(lambda x, y: x + y, [F.when(F.col(k).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(keys)])
    return df.select("*", *[F.coalesce(F.col(k), empty(t)).alias(f"_k_{k}") for k, t in zip(keys, kinds)], nulls.alias("_nulls")).drop(*keys)


def beside(df: DataFrame, few: DataFrame, by: list[str] | None = None) -> DataFrame:
    """df with the columns of a table of one row per `by` (snapshot, endpoint), or of one row. It is broadcast: a shuffle by so few keys would put all
    rows of one into a task."""
    return same(df, F.broadcast(few), by) if by else df.crossJoin(F.broadcast(few))


def cumulated(df: DataFrame, keys: list[str], value: str, flags: list[str] | None = None, scarce: bool = False, of: DataFrame | None = None) -> DataFrame:
    """keys, value, flags, _c (rows), _upto (rows of the key up to here, by value), _n (rows of the key). Null values have no rank.

    scarce: a key seldom has a value twice (durations of a chain), so rows go to their buckets at once, by the one shuffle of theirs; otherwise
    equal values are counted before it. of: see dealt()."""
    key, out = [f"_k_{k}" for k in keys] + ["_nulls"], [*keys, value, *(flags or [])]
    df = _filled(df.select(*out), keys)
    own = [*key, value, *(flags or [])]
    bucket = F.coalesce(F.shiftright(value, BUCKET_BITS), F.lit(0)).alias("_b")
    if scarce:
        h = dealt(df.select(*own, bucket), *key, "_b", of=of).groupBy(*own, "_b").agg(F.count("*").alias("_c"))
    else:
        h = df.groupBy(*own).agg(F.count("*").alias("_c")).select(*own, "_c", bucket).repartition(*key, "_b")
    ranked = F.when(F.col(value).isNull(), F.lit(0)).otherwise(F.col("_c"))
    whole = Window.partitionBy(*key)
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    b = h.groupBy(*key, "_b").agg(F.sum(ranked).alias("_s")).select(*key, "_b", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_base"), F.sum("_s").over(whole).alias("_n"))
    within = Window.partitionBy(*key, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    x = h.join(b, [*key, "_b"]).withColumn("_upto", F.col("_base") + F.sum(ranked).over(within))
    return x.select(*[F.when(F.getbit("_nulls", F.lit(i)) == 0, F.col(c)).alias(k) for i, (k, c) in enumerate(zip(keys, key))], value, *(flags or []), "_c", "_n", "_upto")


def at_rank(rank: Column, value: str) -> Column:
    """The value of that rank (from 1), of rows that cumulated() made."""
    return F.min(F.when(F.col("_upto") >= rank, F.col(value)))


def time_stats(d: str = "duration_us") -> list[Column]:
    """Of rows that cumulated() made. Percentile p is the ceil(n * p)-th smallest, null if that is the last; the median needs 3 values."""
    n = F.col("_n")
    most = F.max("_n")
    weight = F.when(F.col(d).isNotNull(), F.col("_c"))
    middle = (at_rank(F.floor((n + 1) / 2), d) + at_rank(F.floor(n / 2) + 1, d)) / 2
    return [
        F.round(F.min(d) / 1000, 6).alias("min_ms"), F.round(F.sum(F.col(d) * F.col("_c")) / F.sum(weight) / 1000, 6).alias("avg_ms"), F.round(F.max(d) / 1000, 6).alias("max_ms"),
        F.round(F.when(most >= 3, middle / 1000), 6).alias("median_ms"),
        *[F.round(F.when(F.ceil(most * F.lit(float(p))) < most, at_rank(F.ceil(n * F.lit(float(p))), d) / 1000), 6).alias(f"p{round(100 * p)}_ms") for p in PERCENTILES],
    ]


#: Width in µs of the slices of time whose starts are put in order together: an hour.
SLICE_US = 3_600_000_000


def rates(df: DataFrame, keys: list[str], start: str = "start_us", outliers: int | DataFrame = 0, least: int = 12, scarce: bool = False) -> DataFrame:
    """keys, avg_rate, median_rate (per second) of start times; null under outliers + `least` starts. The largest `outliers` gaps don't
    count: a number, or a table of _out and any of the keys, with one row of each (few, see beside()). Gaps within a slice of time come from its own starts,
    gaps between from its first and the last before."""
    x = df.where(F.col(start).isNotNull()).select(*keys, F.col(start).alias("_t"), F.floor(F.col(start) / SLICE_US).alias("_s"))
    x = dealt(x, *keys, "_s")
    inner = x.withColumn("_gap", F.col("_t") - F.lag("_t").over(Window.partitionBy(*keys, "_s").orderBy("_t"))).where("_gap IS NOT NULL").select(*keys, "_gap")
    ends = x.groupBy(*keys, "_s").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    between = ends.select(*keys, (F.col("_lo") - F.lag("_hi").over(Window.partitionBy(*keys).orderBy("_s"))).alias("_gap"))
    g = cumulated(inner.unionByName(between), keys, "_gap", scarce=scarce, of=df)  # a key's first start is a row without a gap
    g = g.withColumn("_out", F.lit(outliers)) if isinstance(outliers, int) else beside(g, outliers, [c for c in outliers.columns if c != "_out"])
    kept = F.greatest(F.col("_n") - F.col("_out"), F.lit(0))
    inside = F.greatest(F.least(F.col("_upto"), kept) - (F.col("_upto") - F.col("_c")), F.lit(0))
    a = g.groupBy(*keys).agg(
        F.max("_n").alias("_n"), F.max("_out").alias("_out"), (F.try_divide(F.sum(F.col("_gap") * inside), F.max(kept))).alias("_a"), at_rank(F.floor(kept / 2) + 1, "_gap").alias("_m"),
    )
    rate = lambda gap: F.when(F.col("_n") + 1 >= F.col("_out") + least, F.when(gap == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1e6), gap)))
    return a.select(*keys, F.round(rate(F.col("_a")), 6).alias("avg_rate"), F.round(rate(F.col("_m")), 6).alias("median_rate"))
