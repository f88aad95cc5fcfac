"""Traces from a stream of trace files: spans with a watermark, traces closed by a pause, and statistics per window of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import stats as st
from ..sources import jaeger


def read_span_stream(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Clean spans of the trace files (UTF-8) that arrive in a folder, with start (a timestamp) and a watermark on it. A span that comes
    again within the watermark is dropped."""
    x = spark.readStream.schema(jaeger.SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    traces = x.select(F.lit(0).alias("file_id"), F.posexplode("data").alias("trace_pos", "t")).select("file_id", "trace_pos", F.col("t.traceID").alias("trace_id"), "t.spans", "t.processes")
    spans = jaeger.to_spans(traces)[0].withColumn("start", F.timestamp_micros("start_us")).withWatermark("start", late)
    return spans.dropDuplicatesWithinWatermark(["trace_id", "span_id"])


def closed_traces(spans: DataFrame, pause: str = "10 minutes") -> DataFrame:
    """A record of each trace, once no span of it can start within the pause after its last: call of its only root, times, spans, errors."""
    root = F.col("parent_id").isNull() | (F.col("parent_id") == F.col("span_id"))
    call = F.concat("service", F.lit("/"), "operation")
    x = spans.groupBy(F.session_window("start", pause).alias("w"), "trace_id").agg(
        F.count("*").alias("num_spans"), F.when(F.count_if(root) == 1, F.max(F.when(root, call))).otherwise(F.lit(S.UNKNOWN_ROOT)).alias("root_call"),
        F.min("start_us").alias("start_us"), F.max(F.col("start_us") + F.col("duration_us")).alias("end_us"), F.count_if(F.col("log_level") == "ERROR").alias("num_errors"),
    )
    return x.select("trace_id", "num_spans", "root_call", S.endpoint_key(F.col("root_call")).alias("endpoint"), "start_us", "end_us", "num_errors")


def windowed_stats(spans: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Per window, service and operation: count, least, mean and longest duration and error fractions: a snapshot per window, for stitching."""
    share = lambda c: F.round(F.count_if(F.col(c)) / F.count("*"), 6)
    x = st.flagged(spans).groupBy(F.window("start", width, slide).alias("w") if slide else F.window("start", width).alias("w"), "service", "operation").agg(
        F.count("*").alias("count"), *[F.round(f("duration_us") / 1000, 6).alias(n) for n, f in (("min_ms", F.min), ("avg_ms", F.avg), ("max_ms", F.max))],
        share("_bad").alias("frac_not_http_ok"), share("_err").alias("frac_error_logs"),
    )
    return x.select(F.col("w.start").alias("window_start"), "service", "operation", "count", "min_ms", "avg_ms", "max_ms", "frac_not_http_ok", "frac_error_logs")
