"""Trace JSON (nested; UTF-8 or UTF-16 with a byte-order mark) to spans, and text sources: chain files and stitch lists."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

_TAG = "struct<key:string,type:string,value:string>"
SCHEMA = (
    "data array<struct<traceID:string,spans:array<struct<traceID:string,spanID:string,flags:int,operationName:string,"
    "references:array<struct<refType:string,traceID:string,spanID:string>>,startTime:bigint,duration:bigint,"
    f"tags:array<{_TAG}>,logs:array<struct<timestamp:bigint,fields:array<{_TAG}>>>,processID:string,warnings:array<string>>>,"
    f"processes:map<string,struct<serviceName:string,tags:array<{_TAG}>>>,warnings:array<string>>>,total int,limit int,offset int"
)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file, text of each .json file in a folder (not in folders below) or of one file, decoded by its byte-order mark."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    mark = F.hex(F.substring("content", 1, 2))
    text = F.when(mark.isin("FFFE", "FEFF"), F.decode("content", "UTF-16")).otherwise(F.decode("content", "UTF-8"))
    return raw.select(F.col("path").alias("file"), F.regexp_replace(text, "^﻿", "").alias("text"))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """file_id, trace_pos, trace_id, spans, processes: one row per trace, in the order of files and within them."""
    files = read_files(spark, path).withColumn("j", F.from_json("text", SCHEMA))
    ids = files.select("file").withColumn("file_id", F.dense_rank().over(Window.orderBy("file")) - 1)  # a row per file
    return files.join(ids, "file").select("file_id", F.posexplode("j.data").alias("trace_pos", "t")).select("file_id", "trace_pos", F.col("t.traceID").alias("trace_id"), "t.spans", "t.processes")


def _tag(tags: Column, key: str) -> Column:
    """The value of the last tag of that key."""
    return F.element_at(F.transform(F.filter(tags, lambda t: t["key"] == key), lambda t: t["value"]), -1)


def _tag_map(tags: Column) -> Column:
    """Tags as a map, the last of each key."""
    keys = F.array_distinct(F.filter(F.transform(tags, lambda t: t["key"]), lambda k: k.isNotNull()))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: _tag(tags, k)))


def to_spans(traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean spans, and issues (trace_id, message): spans of several references, and status codes that aren't numbers."""
    s = traces.select("file_id", "trace_pos", "trace_id", "processes", F.posexplode("spans").alias("span_idx", "s"))
    last = lambda tags, key: F.when(F.size(F.filter(tags, lambda t: t["key"] == key)) > 0, _tag(tags, key))
    code = last(F.col("s.tags"), "http.status_code")
    kind = last(F.col("s.tags"), "span.kind")
    raw = F.col("s.operationName")
    rest = F.filter("s.tags", lambda t: ~t["key"].isin("http.status_code", "span.kind"))
    process = F.element_at("processes", F.col("s.processID"))
    logs = F.transform("s.logs", lambda x: F.struct(x["timestamp"].alias("timestamp"), last(x["fields"], "level").alias("level"), S.truncate_message(last(x["fields"], "message")).alias("msg")))
    n_refs = F.coalesce(F.size("s.references"), F.lit(0))
    spans = s.select(
        "file_id", "trace_pos", "trace_id", "span_idx", F.col("s.spanID").alias("span_id"), F.when(n_refs > 0, F.get("s.references", F.lit(0))["spanID"]).alias("parent_id"),
        F.coalesce(process["serviceName"], F.lit("-")).alias("service"), S.unify_operation(raw).alias("operation"), raw.alias("full_operation"),
        F.col("s.startTime").alias("start_us"), F.col("s.duration").alias("duration_us"), kind.alias("span_kind"), S.call_direction(kind).alias("call_direction"), code.try_cast("short").alias("http_status_code"),
        _tag_map(rest).alias("attributes"), _tag_map(process["tags"]).alias("process_tags"), logs.alias("logs"),
        F.when(F.exists(logs, lambda x: x["level"] == "ERROR"), "ERROR").alias("log_level"), n_refs.alias("_refs"), (code.isNotNull() & code.try_cast("short").isNull()).alias("_bad"),
    )
    issues = spans.where("_refs > 1 OR _bad").select("trace_id", F.concat(F.lit("span "), "span_id", F.when(F.col("_refs") > 1, ": several references").otherwise(": bad http.status_code")).alias("message"))
    return spans.where("_refs <= 1").drop("_refs", "_bad"), issues


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """chain, caching, is_leaf of a chain file: one text a line; blank lines and comments are skipped."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')")
    return lines.select(S.parse_chain(F.col("value")).alias("p")).select("p.*")


def stitch_list(lines: list[str], base: str = ".") -> list[tuple[int | None, str, str | None]]:
    """(column, description, path) of each line: # is a comment, % an empty column, else a path relative to base, with an optional comment."""
    out: list[tuple[int | None, str, str | None]] = []
    column = 0
    for line in (x.strip() for x in lines):
        if not line:
            continue
        if line.startswith("#"):
            out.append((None, line[1:].strip(), None))
            continue
        path, _, note = line.partition("#")
        empty = line.startswith("%")
        out.append((column, (line[1:] if empty else note or path).strip(), None if empty else str(PurePosixPath(base) / path.strip())))
        column += 1
    return out


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def chain_folder(path: str, caching: list[str] | None = None) -> str:
    """Where the chains of a set of caching processes are kept."""
    return f"{path}/{'_'.join(sorted(caching)) if caching else 'default'}"


def write_chains(known: DataFrame, path: str) -> None:
    """known: endpoint, call_chain, is_leaf, and caching_process if there is any; a text per endpoint folder, one rendered chain a line. What is there stays, and
    chains that it has aren't written again."""
    label = F.col("caching_process") if "caching_process" in known.columns else F.lit("")
    new = known.select("endpoint", S.chain_key(F.col("call_chain"), label, F.col("is_leaf")).alias("value")).distinct()
    if exists(known.sparkSession, path):
        old = known.sparkSession.read.text(path).select(F.col("endpoint").cast("string").alias("endpoint"), "value")
        new = new.join(old, ["endpoint", "value"], "left_anti")
    new.write.mode("append").partitionBy("endpoint").text(path)


def read_known(spark: SparkSession, path: str) -> DataFrame:
    """endpoint, call_chain, is_leaf, caching_process of what write_chains() wrote."""
    x = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')")
    return x.select(F.col("endpoint").cast("string").alias("endpoint"), S.parse_chain(F.col("value")).alias("p")).select("endpoint", F.col("p.chain").alias("call_chain"), "p.is_leaf", F.col("p.caching").alias("caching_process"))
