"""A viewer of one snapshot or of stitched series: ranked lists, charts, selections and diagrams, as DataFrames."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import graph, snapshot, stitch
from ..sources import jaeger


class Metric(Enum):
    """Metrics and their labels."""

    NONE = "NONE"
    NUM_FILES = "num_files"
    OCCURANCE_PERCENTAGE = "occurance percentage"
    NUM_TRACES = "num_traces"
    NUM_ENDPOINTS = "num_endpoints"
    NUM_INCOMPLETE_TRACES = "num_incomplete_traces"
    NUM_CALL_CHAINS = "num_call_chains"
    INIT_NUM_UNROOTED_CC = "init_num_unrooted_cc"
    NUM_FIXES = "num_fixes"
    NUM_UNROOTED_CC_AFTER_FIXES = "num_unrooted_cc_after_fixes"
    FRAC_NOT_HTTP_OK = "frac_not_http_ok"
    FRAC_ERROR_LOGS = "frac_error_logs"
    COUNT = "count"
    RATE = "rate (req/sec)"
    MIN_DURATION_MILLIS = "minimal duration millis"
    AVG_DURATION_MILLIS = "average duration millis"
    MEDIAN_DURATION_MILLIS = "median duration millis"
    MAX_DURATION_MILLIS = "maximal duration millis"
    P75_MILLIS = "p75 millis"
    P90_MILLIS = "p90 millis"
    P95_MILLIS = "p95 millis"
    P99_MILLIS = "p99 millis"

    @classmethod
    def of(cls, label: str) -> Metric:
        for m in cls:
            if m is not cls.NONE and m.value == label.lower():
                return m
        raise ValueError(f"no metric is called {label}")


class Viewer:
    """series: service, operation, metric, x, y. keyed: spans with chains (operators.stats.with_keys), or, where there are no spans, chains with their
    count (stitched series). Viewers don't change; select() gives a new one."""

    def __init__(self, series: DataFrame, keyed: DataFrame, columns: int):
        self.series, self.keyed, self.columns = series, keyed, columns

    @classmethod
    def from_folder(cls, spark: SparkSession, path: str) -> Viewer:
        """The viewer of a folder that the command trace_analysis or stitch wrote. Raises FileNotFoundError if it is neither."""
        if jaeger.exists(spark, f"{path}/operations"):
            series = spark.read.parquet(f"{path}/operations")
            parsed = S.parse_chain(F.col("chain_key"))
            chains = spark.read.parquet(f"{path}/chain_info").withColumn("_p", parsed).select("chain_key", F.col("_p.chain").alias("call_chain"), "is_leaf", "rooted", "count")
            return cls(series, chains, 1 + (spark.read.parquet(f"{path}/basic").agg(F.max("x")).first()[0] or 0))
        if not jaeger.exists(spark, f"{path}/oper_stats"):
            raise FileNotFoundError(f"no snapshot and no stitched series: {path}")
        own = spark.read.parquet(f"{path}/oper_stats").withColumnRenamed("occurrence", "occurance percentage").withColumn("x", F.lit(0))
        return cls(snapshot._long(own, ["service", "operation", "x"], snapshot.OPERATION), spark.read.parquet(f"{path}/spans"), 1)

    def chains(self, statistics: bool = False) -> DataFrame:
        """chain_key, call_chain, steps and count of each chain; with statistics, where there are spans."""
        if "count" in self.keyed.columns:
            return self.keyed.withColumn("steps", F.transform("call_chain", S.plain_call))
        return graph.chain_table(self.keyed, statistics)

    @property
    def is_time_series(self) -> bool:
        return self.columns > 1

    def lines(self) -> DataFrame:
        return stitch.lines(self.series, ["service", "operation", "metric"], self.columns)

    def process_list(self, metric: str | None = None) -> DataFrame:
        """Services and operations by growth of a metric (-1: none), or in alphabetical order."""
        name = F.concat("service", F.lit("/"), "operation").alias("name")
        if metric is None:
            return stitch.lexicographic(self.series.select(name).distinct(), "name")
        return stitch.ranked(self.lines().where(F.col("metric") == metric).select(name, F.coalesce("growth", F.lit(-1.0)).alias("rank")), "rank", "name")

    def chain_counts(self, service: str, scope: str = "inbound", operation: str | None = None) -> DataFrame:
        """chain_key, count, chain_type of chains that end in a service or one of its operations; or (end2end: leaves, all) that only pass through it."""
        last = F.element_at("call_chain", -1)
        own = (last["service"] == service) & (F.lit(True) if operation is None else last["operation"] == operation)
        x = self.keyed
        x = x.where(own) if scope == "inbound" else x.where(~own & F.contains("chain_key", F.lit(f"{service}/{operation or ''}")))
        if scope == "end2end":
            x = x.where("is_leaf")
        n = F.sum("count") if "count" in x.columns else F.count("*")
        return x.groupBy("chain_key").agg(n.alias("count"), S.chain_type(F.bool_and("rooted"), F.bool_and("is_leaf")).alias("chain_type"))

    def inbound_prefixes(self, service: str, operation: str | None = None) -> DataFrame:
        """prefix, idx: the texts of the chains that end there, by the place of their chain in the list."""
        x = self.chain_list(service, "inbound", operation).select(F.regexp_extract("chain_key", "^(.*?) & ", 1).alias("prefix"), "idx")
        return x.groupBy("prefix").agg(F.min("idx").alias("idx"))

    def chain_list(self, service: str, scope: str = "inbound", operation: str | None = None, inbound_idx: int | None = None) -> DataFrame:
        """chain_counts() with rank (the count) and idx from 1. Chains that pass through have inbound_idx too, which of the inbound chains they begin with (0: none),
        and may be limited to one."""
        x = self.chain_counts(service, scope, operation).withColumn("rank", F.col("count"))
        if scope != "inbound":
            x = x.join(graph.inbound_prefix(x, self.inbound_prefixes(service, operation)), "chain_key")
            if inbound_idx is not None:
                x = x.where(F.col("inbound_idx") == inbound_idx)
        return stitch.ranked(x, "rank", "chain_key")

    def chart(self, service: str, operation: str, metric: str) -> DataFrame:
        """x, observed, linear, exponential."""
        is_it = (F.col("service") == service) & (F.col("operation") == operation) & (F.col("metric") == metric)
        fit = self.lines().where(is_it).select("slope", "intercept", "exp_a", "exp_b")
        x = self.series.sparkSession.range(self.columns).select(F.col("id").cast("int").alias("x"))
        x = x.join(self.series.where(is_it).select("x", F.col("y").alias("observed")), "x", "left").join(F.broadcast(fit))
        return x.select("x", "observed", (F.col("intercept") + F.col("slope") * F.col("x")).alias("linear"), (F.col("exp_a") * F.pow("exp_b", "x")).alias("exponential"))

    def select(self, chosen: list[bool]) -> Viewer:
        """Only the chosen columns, numbered anew; fits are computed again."""
        if len(chosen) != self.columns:
            raise ValueError(f"{len(chosen)} marks for {self.columns} columns")
        own = [i for i, c in enumerate(chosen) if c]
        return Viewer(stitch.select_columns(self.series, own), self.keyed, len(own))

    def file_stats(self, basic: DataFrame) -> DataFrame:
        """Whole snapshots as a table: a row per metric, a column per snapshot of the original data. basic: x, metric, y."""
        return basic.groupBy("metric").pivot("x", list(range(self.columns))).agg(F.max("y")).orderBy(snapshot.metric_order(snapshot.BASIC, F.col("metric")))

    def chain_chart(self, chain_series: DataFrame, chain_key: str, metric: str) -> DataFrame:
        """x, observed, linear, exponential of a chain. chain_series: chain_key, x, metric, y."""
        own = chain_series.where(F.col("chain_key") == chain_key).select(F.lit("chain").alias("service"), F.lit("").alias("operation"), "metric", "x", "y")
        return Viewer(own, self.keyed, self.columns).chart("chain", "", metric)

    def diagram(self, service: str, operation: str | None = None, selected: str | None = None, metric: str = "count", scope: str = "full", compact: bool = False) -> str:
        """Diagram text of the chains that lead to a service or one of its operations; a selected chain is emphasised."""
        if metric not in graph.VALUES:
            raise ValueError(f"{metric} can't be shown on a link")
        name = service if operation is None else f"{service}/{operation}"
        if metric != "count" and "count" in self.keyed.columns:
            raise ValueError("stitched chains have counts only")
        rows = graph.service_graph(self.chains(metric != "count"), graph.paths(self.keyed), service, operation, selected).collect()  # a row for each pair of calls
        return graph.mermaid([r.asDict() for r in rows], graph.VALUES[metric], f"{name} (metric={metric})", service, operation, scope, compact)
