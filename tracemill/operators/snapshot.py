"""Snapshots: broken chains repaired, statistics before and after, report tables, and snapshots as series of metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import timestats as T
from . import spans as sp
from . import stats as st

#: Metrics of a level in report order; the columns they come from carry the same labels.
BASIC = (
    "num_files", "rate (req/sec)", "num_traces", "num_endpoints", "num_incomplete_traces", "num_call_chains", "init_num_unrooted_cc", "num_fixes", "num_unrooted_cc_after_fixes",
    "minimal duration millis", "average duration millis", "median duration millis", "p75 millis", "p90 millis", "p95 millis", "p99 millis", "maximal duration millis",
)
OPERATION = (
    "count", "occurance percentage", "rate (req/sec)", "minimal duration millis", "average duration millis", "median duration millis", "maximal duration millis",
    "p75 millis", "p90 millis", "p95 millis", "p99 millis", "frac_not_http_ok", "frac_error_logs",
)
LABELS = {
    "min_ms": "minimal duration millis", "avg_ms": "average duration millis", "median_ms": "median duration millis", "max_ms": "maximal duration millis",
    "p75_ms": "p75 millis", "p90_ms": "p90 millis", "p95_ms": "p95 millis", "p99_ms": "p99 millis", "avg_rate": "rate (req/sec)",
}


def chain_fixes(keyed: DataFrame, traces: DataFrame | None, known: DataFrame) -> DataFrame:
    """chain_key, endpoint, matches, new_key, new_chain, new_leaf of the broken chains that a known chain of their most frequent root completes."""
    roots = st.expected_roots(keyed, traces).withColumn("endpoint", S.endpoint_key(F.col("expected_root")))
    broken = keyed.where("NOT rooted").select("chain_key", "call_chain", "caching_process", "is_leaf").distinct()
    return st.repair_chains(broken.join(roots, "chain_key"), known)


def repaired(keyed: DataFrame, fixes: DataFrame) -> DataFrame:
    """keyed with completed chains in place of broken ones, rooted then; all measures of a span move with it."""
    new = fixes.select("chain_key", F.col("new_key"), "new_chain", "new_leaf")
    x = keyed.join(new, "chain_key", "left").withColumn("fixed", F.col("new_key").isNotNull() & ~F.col("rooted"))
    pick = lambda a, b: F.when(F.col("fixed"), F.col(a)).otherwise(F.col(b)).alias(b)
    chain = F.when(F.col("fixed"), F.col("new_chain")).otherwise(F.col("call_chain"))
    own = {"chain_key": pick("new_key", "chain_key"), "call_chain": chain, "is_leaf": pick("new_leaf", "is_leaf"), "rooted": F.col("rooted") | F.col("fixed")}
    return x.withColumns({**own, "depth": F.size(chain), "loops": F.array_join(S.looped(chain), ","), "inbound_key": S.inbound_key(chain)}).drop("new_key", "new_chain", "new_leaf")


def path_errors(spans: DataFrame) -> DataFrame:
    """spans (with trace_id, span_idx, parent_idx) with path_bad and path_err: whether any span from the root down to it had one.

    One array per trace; flags double along parent pointers, so the depth of a trace costs log2 rounds."""
    x = sp.gathered(sp.flagged(spans), "span_idx", "parent_idx", ["span_idx", "_bad", "_err"])
    start = lambda s, i: F.struct(F.coalesce(F.get("_up", i), F.lit(0)).alias("p"), s["_bad"].alias("b"), s["_err"].alias("e"))
    x = x.withColumn("_f", F.transform("_s", start)).withColumn("_f", sp.doubled("_f", "'b', x.b or y.b, 'e', x.e or y.e"))
    flags = x.select("trace_id", F.inline(F.arrays_zip("_s", "_f"))).select("trace_id", "_s.span_idx", F.col("_f.b").alias("path_bad"), F.col("_f.e").alias("path_err"))
    return spans.join(flags, ["trace_id", "span_idx"])


def chain_counters(keyed: DataFrame, keys: tuple[str, ...] | list[str] = ("chain_key",)) -> DataFrame:
    """keys, http_not_ok and error_logs: spans of a chain whose path held an error, as parts of all."""
    part = lambda c, name: F.round(F.count_if(F.col(c)) / F.count("*"), 6).alias(name)
    if "path_bad" not in keyed.columns:
        keyed = path_errors(keyed)
    return keyed.groupBy(*keys).agg(part("path_bad", "frac_not_http_ok"), part("path_err", "frac_error_logs"))


def counters(traces: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: files, traces, endpoints, incomplete traces, chains, unrooted chains before and after repair, and chains repaired."""
    own = traces.agg(F.countDistinct("file_id").alias("num_files"), F.count("*").alias("num_traces"), F.countDistinct("endpoint").alias("num_endpoints"), F.count_if(F.col("num_missing") > 0).alias("num_incomplete_traces"))
    chains = lambda k: k.groupBy("chain_key").agg(F.bool_and("rooted").alias("rooted"))
    a = chains(before).agg(F.count_if(~F.col("rooted")).alias("init_num_unrooted_cc"))
    b = chains(after).agg(F.count("*").alias("num_call_chains"), F.count_if(~F.col("rooted")).alias("num_unrooted_cc_after_fixes"))
    one = F.lit(1).alias("_k")
    out = own.select("*", one).join(a.select("*", one), "_k").join(b.select("*", one), "_k").drop("_k")  # one row each
    return out.withColumn("num_fixes", F.col("init_num_unrooted_cc") - F.col("num_unrooted_cc_after_fixes"))


def endpoint_counters(traces: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per endpoint, of what counters() has for the whole set; before and after carry endpoint. traces: trace_records(), or counts of traces (chaincount)."""
    incomplete = F.col("num_missing") > 0
    lost = F.sum(F.when(incomplete, F.col("count")).otherwise(0)) if "count" in traces.columns else F.count_if(incomplete)
    own = traces.groupBy("endpoint").agg(F.countDistinct("file_id").alias("num_files"), st.rows(traces).alias("num_traces"), lost.alias("num_incomplete_traces"))
    own = own.withColumn("incomplete_percentage", F.round(100 * F.col("num_incomplete_traces") / F.col("num_traces"), 6))
    chains = lambda k: k.groupBy("endpoint", "chain_key").agg(F.bool_and("rooted").alias("rooted")).groupBy("endpoint")
    n, lost = F.count("*"), F.count_if(~F.col("rooted"))
    out = T.same(own, chains(before).agg(lost.alias("init_num_unrooted_cc")), ["endpoint"])
    out = T.same(out, chains(after).agg(n.alias("num_call_chains"), lost.alias("num_unrooted_cc_after_fixes")), ["endpoint"])
    return out.withColumn("num_fixes", F.col("init_num_unrooted_cc") - F.col("num_unrooted_cc_after_fixes"))


def endpoint_tables(traces: DataFrame, before: DataFrame, after: DataFrame) -> dict[str, DataFrame]:
    """The tables of a snapshot for each endpoint by itself, all endpoints in one pass: endpoint leads every key. traces: trace_records();
    before and after: spans with keys, as found and as repaired."""
    own = traces.select("trace_id", "endpoint")
    before, after = (T.same(df, own, ["trace_id"]) for df in (before, after))
    total, by = endpoint_counters(traces, before, after), ["endpoint"]
    return {
        "endpoint_summary": total, "endpoint_service_stats": service_report(after, total, by), "endpoint_oper_stats": oper_report(after, total, by), "endpoint_chain_stats": chain_report(after, total, by),
    }


def analyse(spans: DataFrame, caching: list[str] | None = None, known: DataFrame | None = None, stored: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> dict[str, DataFrame]:
    """All tables of a snapshot. known: endpoint, call_chain, is_leaf of earlier runs; the result's known_chains adds this run's.
    stored(table, name) may write what is needed more than once and read it again, so that it is computed once."""
    keyed = stored(st.with_keys(sp.with_paths(spans), caching), "paths")
    traces = sp.trace_records(keyed)
    own = st.known_chains(keyed, traces)
    known = st.merge_known(known, own) if known is not None else own
    after = stored(repaired(keyed, chain_fixes(keyed, traces, known)), "spans")
    total = counters(traces, keyed, after)
    return {
        "spans": after, "traces": traces, "snapshot": total, "basic": basic_series(*[t.withColumn("snapshot_id", F.lit(0)) for t in (traces, keyed, after)]).drop("x"), "known_chains": known, "service_stats": service_report(spans, total), "oper_stats": oper_report(spans, total),
        "chain_stats": chain_report(after, total), "uncorrected_chain_stats": chain_report(keyed.withColumn("fixed", F.lit(False)), total),
        **endpoint_tables(traces, keyed, after),
    }


def _of_all(df: DataFrame, total: DataFrame, by: list[str] | None = None) -> DataFrame:
    """df with _traces and _files of the snapshot's one row, or of its row of the same `by`."""
    return T.beside(df, total.select(*(by or []), F.col("num_traces").alias("_traces"), F.col("num_files").cast("int").alias("_files")), by)


def service_report(spans: DataFrame, total: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of calls of each service, and how many a trace."""
    per = lambda c: F.round(F.col(f"num_{c}") / F.col("_traces"), 6).alias(f"freq_{c}")
    return _of_all(st.service_stats(spans, by), total, by).select(*(by or []), "service", "num_traces", "num_received", "num_outbound", "num_unknown", per("received"), per("outbound"), per("unknown"))


def _with_rates(df: DataFrame, own: DataFrame, total: DataFrame, keys: list[str], by: list[str] | None, rates: bool) -> DataFrame:
    if rates:
        own = T.same(own, T.rates(df, keys, outliers=total.select(*(by or []), F.col("num_files").cast("int").alias("_out")), scarce="chain_key" in keys), keys)
    x = _of_all(own, total, by)
    share = F.col("count") / F.col("_traces")
    return x.withColumns({"occurrence": F.round(share, 6), "expect_duration": F.round(share * F.col("avg_ms"), 6)}).drop("_traces", "_files")


def oper_report(spans: DataFrame, total: DataFrame, by: list[str] | None = None, rates: bool = True) -> DataFrame:
    """Statistics of each service and operation, rates unless they aren't asked for, how often a trace calls it and the time expected from that."""
    keys = [*(by or []), "service", "operation"]
    return _with_rates(spans, st.oper_stats(spans, keys), total, keys, by, rates)


def chain_report(keyed: DataFrame, total: DataFrame, by: list[str] | None = None, rates: bool = True, facts: bool = True) -> DataFrame:
    """Statistics of each chain; its ends, hash and loops (facts) and rates unless they aren't asked for; errors are those anywhere along the chain."""
    own_endpoint = F.first(S.plain_call(F.get("call_chain", F.lit(0)))).alias("first_call" if by else "endpoint")
    keys = [*(by or []), "chain_key"]
    of_chain = keyed.groupBy(*keys).agg(
        F.first("inbound_key").alias("inbound_key"), F.first("loops").alias("loops"), F.first("caching_process").alias("caching_process"), F.bool_or("fixed").alias("repaired"),
        own_endpoint, F.first(S.plain_call(F.element_at("call_chain", -1))).alias("leaf"),
    )
    own = st.chain_stats(keyed, by)
    if "path_bad" not in keyed.columns:
        own = T.same(own, chain_counters(keyed, keys), keys)
    if facts:
        own = T.same(own, of_chain, keys)
    own = own.withColumn("cc_hash", S.string_hash(F.col("chain_key")))
    out = _with_rates(keyed, own, total, keys, by, rates)
    return out.withColumn("expect_contribution", F.when(F.col("is_leaf"), F.col("expect_duration")).otherwise(F.lit(0.0)))


def _long(df: DataFrame, keys: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """keys, metric, y; metrics without a value are left out."""
    df = df.withColumnsRenamed(LABELS)
    return df.select(*keys, *[F.col(f"`{m}`").cast("double").alias(m) for m in metrics]).unpivot(keys, list(metrics), "metric", "y").where("y IS NOT NULL")


def series(df: DataFrame, traces: DataFrame, keys: list[str], x: str = "snapshot_id", errors: DataFrame | None = None) -> DataFrame:
    """keys, x, metric, y: the thirteen metrics of services and operations, or of chains, in each snapshot. errors: keys, x and error
    fractions in place of those of the spans themselves."""
    own = [*keys, x]
    total = traces.groupBy(x).agg(F.count("*").alias("_traces"), F.countDistinct("file_id").cast("int").alias("_files"))
    scarce = "chain_key" in keys
    g = T.cumulated(st.flagged(df), own, "duration_us", ["_bad", "_err"], scarce).groupBy(*own).agg(*st.measures())
    if errors is not None:
        g = g.drop("frac_not_http_ok", "frac_error_logs").join(errors, own)
    rate = T.rates(df, own, outliers=total.select(x, F.col("_files").alias("_out")), scarce=scarce)
    g = T.beside(T.same(g, rate, own), total, [x]).withColumn("occurance percentage", F.col("count") / F.col("_traces"))
    return _long(g, own, OPERATION).withColumnRenamed(x, "x")


def basic_series(traces: DataFrame, keyed: DataFrame, after: DataFrame, x: str = "snapshot_id") -> DataFrame:
    """x, metric, y: the seventeen metrics of whole snapshots. Tables carry x."""
    own = traces.groupBy(x).agg(
        F.countDistinct("file_id").cast("int").alias("num_files"), F.count("*").alias("num_traces"), F.countDistinct("endpoint").alias("num_endpoints"), F.count_if(F.col("num_missing") > 0).alias("num_incomplete_traces"),
    )
    chains = lambda k: k.groupBy(x, "chain_key").agg(F.bool_and("rooted").alias("rooted")).groupBy(x)
    n, lost = F.count("*"), F.count_if(~F.col("rooted"))
    own = own.join(chains(keyed).agg(lost.alias("init_num_unrooted_cc")), x).join(chains(after).agg(n.alias("num_call_chains"), lost.alias("num_unrooted_cc_after_fixes")), x)
    own = own.withColumn("num_fixes", F.col("init_num_unrooted_cc") - F.col("num_unrooted_cc_after_fixes"))
    own = own.join(T.cumulated(traces, [x], "duration_us").groupBy(x).agg(*T.time_stats()), x)
    own = own.join(T.rates(traces, [x], outliers=own.select(x, F.col("num_files").alias("_out"))), x)
    return _long(own, [x], BASIC).withColumnRenamed(x, "x")


def metric_order(metrics: tuple[str, ...], metric: Column) -> Column:
    """Where a metric stands in a report."""
    return F.array_position(F.array(*map(F.lit, metrics)), metric)
