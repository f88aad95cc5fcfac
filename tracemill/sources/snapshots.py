"""Snapshots and stitched series on disk: tables as Parquet or JSON, series stitched from many snapshots, and older JSON forms of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import timestats as T
from ..operators import snapshot as sn
from ..operators import stitch as R

TABLES = ("traces", "snapshot", "basic", "known_chains", "service_stats", "oper_stats", "chain_stats", "uncorrected_chain_stats", "endpoint_summary", "endpoint_service_stats", "endpoint_oper_stats", "endpoint_chain_stats")
#: Labels of metrics in older files.
LEGACY_LABELS = {
    "rate (avg)": "rate (req/sec)", "min_millis": "minimal duration millis", "min_duration_millis": "minimal duration millis", "max_millis": "maximal duration millis",
    "max_duration_millis": "maximal duration millis", "avg_duration_millis": "average duration millis", "median_duration_millis": "median duration millis",
    "p75_millis": "p75 millis", "p90_millis": "p90 millis", "p95_millis": "p95 millis", "p99_millis": "p99 millis",
}
#: Names of metrics in stitched records, and their labels.
VARIANTS = {
    "NumFiles": "num_files", "OccurancePercentage": "occurance percentage", "NumTraces": "num_traces", "NumEndpoints": "num_endpoints", "NumIncompleteTraces": "num_incomplete_traces",
    "NumCallChains": "num_call_chains", "InitNumUnrootedCallChains": "init_num_unrooted_cc", "NumFixes": "num_fixes", "NumUnrootedCallChainsAfterFixes": "num_unrooted_cc_after_fixes",
    "FracNotHttpOk": "frac_not_http_ok", "FracErrorLogs": "frac_error_logs", "Count": "count", "Rate": "rate (req/sec)", "MinDurationMillis": "minimal duration millis",
    "AvgDurationMillis": "average duration millis", "MedianDurationMillis": "median duration millis", "MaxDurationMillis": "maximal duration millis",
    "P75Millis": "p75 millis", "P90Millis": "p90 millis", "P95Millis": "p95 millis", "P99Millis": "p99 millis",
}


def write_snapshot(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """A folder with a table each; form: parquet or json."""
    for name in TABLES:
        if name in tables:
            tables[name].write.mode("overwrite").format(form).save(f"{path}/{name}")


def read_snapshot(spark: SparkSession, path: str, form: str = "parquet") -> dict[str, DataFrame]:
    return {name: spark.read.format(form).load(f"{path}/{name}") for name in ("traces", "snapshot", "basic", "service_stats", "oper_stats", "chain_stats")}


def stitch(spark: SparkSession, paths: list[str | None], drop_count: int = 0) -> dict[str, DataFrame]:
    """Snapshot folders in order (None: a gap) to series: basic (x, metric, y), operations, chains; and the services dropped for
    receiving no more than drop_count calls in all snapshots together."""
    parts: dict[str, list[DataFrame]] = {"basic": [], "service_stats": [], "oper_stats": [], "chain_stats": []}
    for x, path in enumerate(paths):
        for name in parts if path else ():
            parts[name].append(spark.read.parquet(f"{path}/{name}").withColumn("x", F.lit(x)))
    union = {}
    for name, own in parts.items():
        if not own:
            raise ValueError("no snapshot is listed")
        while len(own) > 1:  # a balanced tree of unions
            own = [a.unionByName(*b) if b else a for a, *b in (own[i : i + 2] for i in range(0, len(own), 2))]
        union[name] = own[0]
    volume = union["service_stats"].withColumnRenamed("x", "snapshot_id")
    kept = R.drop_low_volume(volume, drop_count).select("service").distinct()
    long = lambda df, keys: sn._long(df.withColumnRenamed("occurrence", "occurance percentage"), [*keys, "x"], sn.OPERATION)
    chains = union["chain_stats"].withColumn("service", F.regexp_extract("leaf", "^([^/]*)/", 1)).join(kept, "service", "left_semi")
    info = chains.groupBy("chain_key").agg(F.first("leaf").alias("leaf"), F.first("inbound_key").alias("inbound_key"), F.first("is_leaf").alias("is_leaf"), F.bool_and("rooted").alias("rooted"), F.sum("count").alias("count"))
    return {
        "basic": union["basic"].select("x", "metric", "y"), "operations": long(union["oper_stats"].join(kept, "service", "left_semi"), ["service", "operation"]),
        "chains": long(chains, ["chain_key"]), "chain_info": info, "dropped": volume.join(kept, "service", "left_anti").select("service", "snapshot_id"),
    }


_NUMBERS = "array<bigint>"
_VALUE = f"count bigint,num_traces bigint,depth int,duration_micros {_NUMBERS},start_dt_micros {_NUMBERS},looped array<string>,rooted boolean"
_CALLS = "call_chain array<struct<service:string,process:string,operation:string,method:string,call_direction:string>>,caching_process string,is_leaf boolean"
_RECORD = (
    f"trace_id array<string>,root_call array<string>,num_spans {_NUMBERS},num_files int,num_endpoints bigint,num_incomplete_traces bigint,num_call_chains bigint,init_num_unrooted_cc bigint,num_fixes bigint,"
    f"num_unrooted_cc_after_fixes bigint,start_dt {_NUMBERS},end_dt {_NUMBERS},duration_micros {_NUMBERS},time_to_respond_micros {_NUMBERS},caching_processes array<string>,"
    "stats map<string,struct<method:map<string,string>,operation:map<string,string>,num_traces:bigint,num_received_calls:bigint,num_outbound_calls:bigint,num_unknown_calls:bigint,call_chain:array<array<string>>>>"
)


def read_snapshot_record(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A snapshot that is one JSON record: lists per trace, and maps of services and operations; chains are (key, value) pairs.
    Services and operations may be called process and method. Returns traces, service_stats, durations (service, operation, count,
    duration_us, start_us lists) and chains."""
    x = spark.read.schema(_RECORD).option("multiLine", True).json(path)
    traces = x.select(F.inline(F.arrays_zip("trace_id", "root_call", "num_spans", "start_dt", "end_dt", "duration_micros", "time_to_respond_micros")))
    traces = traces.withColumnsRenamed({"start_dt": "start_us", "end_dt": "end_us", "duration_micros": "duration_us", "time_to_respond_micros": "time_to_respond_us"})
    own = x.select(F.explode("stats").alias("service", "s"))
    services = own.select("service", "s.num_traces", F.col("s.num_received_calls").alias("num_received"), F.col("s.num_outbound_calls").alias("num_outbound"), F.col("s.num_unknown_calls").alias("num_unknown"))
    value = lambda c: F.from_json(c, _VALUE)
    lists = [F.col("v.count"), F.col("v.num_traces"), F.col("v.duration_micros").alias("duration_us"), F.col("v.start_dt_micros").alias("start_us")]
    durations = own.select("service", F.explode(F.coalesce("s.operation", "s.method")).alias("operation", "v")).withColumn("v", value("v")).select("service", "operation", *lists)
    pairs = own.select("service", F.explode("s.call_chain").alias("p")).select("service", F.from_json(F.get("p", F.lit(0)), _CALLS).alias("k"), value(F.get("p", F.lit(1))).alias("v"))
    call = lambda c: F.struct(F.coalesce(c["service"], c["process"]).alias("service"), F.coalesce(c["operation"], c["method"]).alias("operation"), F.coalesce(c["call_direction"], F.lit("Unknown")).alias("call_direction"))
    chains = pairs.select("service", F.transform("k.call_chain", call).alias("call_chain"), F.coalesce("k.caching_process", F.lit("")).alias("caching_process"), "k.is_leaf", "v.rooted", "v.depth", *lists)
    return {"traces": traces, "service_stats": services, "durations": durations, "chains": chains.withColumn("chain_key", S.chain_key(F.col("call_chain"), F.col("caching_process"), F.col("is_leaf")))}


_LINE = "struct<label:string,metric:string,data:array<double>>"
_CHAIN = f"struct<full_key:string,inbound_process_key:string,inboud_process_key:string,rooted:boolean,is_leaf:boolean,data:array<{_LINE}>>"
_STITCHED = f"sources array<struct<column:int,description:string>>,basic array<{_LINE}>,process_operation array<array<string>>,service_operation array<array<string>>,call_chain array<array<string>>"


def read_stitched_record(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Stitched series that are one JSON record, older forms too: metrics under `label` with older names, service_operation called
    process_operation. Fits aren't read: they follow from the data. Returns basic, operations and chains, as stitch() does, and columns."""
    x = spark.read.schema(_STITCHED).option("multiLine", True).json(path)
    names = F.create_map(*[F.lit(v) for kv in {**LEGACY_LABELS, **VARIANTS}.items() for v in kv])
    label = F.coalesce("line.label", "line.metric")
    metric = F.coalesce(F.try_element_at(names, label), label)
    points = lambda df, *keys: df.select(*keys, metric.alias("metric"), F.posexplode("line.data").alias("x", "y")).where("y IS NOT NULL")
    pairs = lambda column, form: x.select(F.explode(column).alias("p")).select(F.get("p", F.lit(0)).alias("name"), F.from_json(F.get("p", F.lit(1)), form).alias("own"))
    oper = pairs(F.coalesce("service_operation", "process_operation"), f"array<{_LINE}>").select(F.regexp_extract("name", "^([^/]*)/(.*)$", 1).alias("service"), F.regexp_extract("name", "^([^/]*)/(.*)$", 2).alias("operation"), F.explode("own").alias("line"))
    chains = pairs(F.col("call_chain"), f"array<{_CHAIN}>").select(F.col("name").alias("leaf"), F.explode("own").alias("c"))
    info = chains.select(F.col("c.full_key").alias("chain_key"), "leaf", F.coalesce("c.inbound_process_key", "c.inboud_process_key").alias("inbound_key"), "c.is_leaf", "c.rooted")
    return {
        "basic": points(x.select(F.explode("basic").alias("line"))), "operations": points(oper, "service", "operation"), "chain_info": info,
        "chains": points(chains.select(F.col("c.full_key").alias("chain_key"), F.explode("c.data").alias("line")), "chain_key"), "columns": x.select(F.size(F.get("basic", F.lit(0))["data"]).alias("columns")), "sources": x.select(F.inline("sources")),
    }


def write_traces(traces: DataFrame, path: str, ids: str = "") -> None:
    """traces (sources.jaeger.read_traces) as JSON, a folder per trace with the envelope they came in. ids: comma-separated; none: all."""
    own = [i for i in ids.split(",") if i]
    x = traces.where(F.col("trace_id").isin(own)) if own else traces
    data = F.array(F.struct(F.col("trace_id").alias("traceID"), "spans", "processes"))
    text = F.to_json(F.struct(data.alias("data"), F.lit(0).alias("total"), F.lit(0).alias("limit"), F.lit(0).alias("offset")), {"pretty": "true"})
    x.select("trace_id", text.alias("value")).write.mode("overwrite").partitionBy("trace_id").text(path)


def trace_texts(keyed: DataFrame, traces: DataFrame) -> DataFrame:
    """trace_id, value: a trace for reading, its record on top and a line per span, indented by its depth, with what calls it and what it carries.

    keyed: spans with paths; traces: trace_records(). One row per trace; lines are ordered by span_idx."""
    known = lambda names: [c for c in names if c in keyed.columns]
    own = known(["span_id", "parent_id", "position", "call_direction", "http_status_code", "start_us", "duration_us", "log_level", "attributes", "process_tags", "logs"])
    value = F.to_json(F.struct(*own))
    line = F.concat(F.repeat(F.lit("  "), F.size("call_chain")), S.plain_call(F.struct("service", "operation")), F.lit(" "), value)
    lines = keyed.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("span_idx", line.alias("line")))).alias("_l"))
    head = traces.select("trace_id", F.to_json(F.struct(*traces.columns)).alias("_h"))
    return T.same(lines, head, ["trace_id"]).select("trace_id", F.concat_ws("\n", "_h", F.transform("_l", lambda x: x["line"])).alias("value"))


def write_trace_texts(keyed: DataFrame, traces: DataFrame, path: str) -> None:
    """trace_texts() in a folder per trace."""
    trace_texts(keyed, traces).write.mode("overwrite").partitionBy("trace_id").text(path, lineSep="\n")
