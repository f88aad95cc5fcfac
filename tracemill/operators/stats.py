"""Snapshot statistics: per service, per service and operation, per call-chain, and for the whole set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import timestats as T
from .spans import flagged


def _share(c: str) -> Column:
    """The part of rows that cumulated() made whose flag c is set."""
    return F.round(F.coalesce(F.sum(F.when(F.col(c), F.col("_c"))), F.lit(0)) / F.sum("_c"), 6)


def measures() -> list[Column]:
    """count, order statistics and error fractions, of flagged spans that cumulated() made."""
    return [F.sum("_c").alias("count"), *T.time_stats(), _share("_bad").alias("frac_not_http_ok"), _share("_err").alias("frac_error_logs")]


def oper_stats(spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per key: count, num_traces, order statistics and error fractions."""
    keys = keys or ["service", "operation"]
    own = T.cumulated(flagged(spans), keys, "duration_us", ["_bad", "_err"]).groupBy(*keys).agg(*measures())
    return T.same(own, spans.groupBy(*keys).agg(F.countDistinct("trace_id").alias("num_traces")), keys)


def service_stats(spans: DataFrame, by: list[str] | None = None) -> DataFrame:
    kind = F.col("span_kind")
    received, outbound = F.count_if(kind == "server"), F.count_if(kind == "client")
    # by trace first: where spans lie by trace, that needs no shuffle of theirs
    own = spans.groupBy(*(by or []), "service", "trace_id").agg(received.alias("_in"), outbound.alias("_out"), F.count("*").alias("_all"))
    return own.groupBy(*(by or []), "service").agg(
        F.count("trace_id").alias("num_traces"), F.sum("_in").alias("num_received"), F.sum("_out").alias("num_outbound"), F.sum(F.col("_all") - F.col("_in") - F.col("_out")).alias("num_unknown"),
    )


def with_keys(paths: DataFrame, caching: list[str] | None = None) -> DataFrame:
    """paths (with_paths) with caching_process, chain_key, depth, loops and inbound_key."""
    chain = F.col("call_chain")
    out = paths.withColumn("caching_process", S.caching_label(caching, chain) if caching else F.lit(""))
    return out.withColumns({
        "chain_key": S.chain_key(chain, F.col("caching_process"), F.col("is_leaf")), "depth": F.size(chain), "loops": F.array_join(S.looped(chain), ","), "inbound_key": S.inbound_key(chain),
    })


def counted(paths: DataFrame, *by: str, first: bool = False, **sums: Column) -> DataFrame:
    """One row per call_chain, is_leaf, rooted and `by` of paths (with_paths): count, the sums, and with `first` the least trace_id and span_idx (seen).
    with_keys() then makes its texts per chain and not per span; chains of equal key are still to be added up."""
    own = [F.count("*").alias("count"), *[F.sum(v).alias(k) for k, v in sums.items()], *([F.min(F.struct("trace_id", "span_idx")).alias("seen")] if first else [])]
    return paths.groupBy("call_chain", "is_leaf", "rooted", *by).agg(*own)


def rows(df: DataFrame) -> Column:
    """How many spans rows stand for: their count, where counted() made them."""
    return F.sum("count") if "count" in df.columns else F.count("*")


def _of_traces(keyed: DataFrame, traces: DataFrame | None, *columns: str) -> DataFrame:
    """keyed with columns of its traces' records; without traces it has them (with_paths, of_trace)."""
    return keyed if traces is None else keyed.drop(*columns).join(traces.select("trace_id", *columns), "trace_id")


def chain_stats(keyed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per chain (of each `by`). Its rooted is that of all its spans together, so it doesn't depend on their order. Where spans have path_bad and
    path_err, with the error fractions of operators.snapshot.chain_counters()."""
    keys = [*(by or []), "chain_key"]
    errors = {"path_bad": "frac_not_http_ok", "path_err": "frac_error_logs"} if "path_bad" in keyed.columns else {}
    h = T.cumulated(keyed, keys, "duration_us", ["depth", "is_leaf", "rooted", *errors], scarce=True)
    return h.groupBy(*keys).agg(
        F.first("depth").alias("depth"), F.first("is_leaf").alias("is_leaf"), F.bool_and("rooted").alias("rooted"), F.sum("_c").alias("count"), *T.time_stats(), *[_share(c).alias(n) for c, n in errors.items()],
    )


def root_calls(traces: DataFrame) -> DataFrame:
    return traces.groupBy("root_call").agg(F.count("*").alias("count"))


def path_counts(keyed: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """How often each path of services and operations is taken; the first match of a pattern in a path's text is rewritten."""
    text = F.array_join(F.transform("call_chain", S.plain_call), "|")
    return keyed.groupBy(F.regexp_replace(text, pattern, replacement).alias("path")).agg(F.count("*").alias("count"))


def http_errors(spans: DataFrame) -> DataFrame:
    """Calls per service and HTTP status, of spans that have one."""
    return spans.where("http_status_code IS NOT NULL").groupBy("service", "http_status_code").agg(F.count("*").alias("count"))


def tag_frequency(tags: DataFrame) -> DataFrame:
    """tags: an array of keys per span. Spans with each key, and their percentage of all."""
    n = tags.agg(F.count("*").alias("_n"))  # one row
    own = tags.select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("count"))
    return own.join(F.broadcast(n)).select("tag", "count", F.round(100 * F.col("count") / F.col("_n"), 6).alias("percentage"))


def _failed(spans: DataFrame) -> DataFrame:
    return flagged(spans).where("_bad OR _err")


def error_traces(spans: DataFrame) -> DataFrame:
    """Traces with spans whose status isn't 200 or that logged an error, and how many such spans."""
    return _failed(spans).groupBy("trace_id").agg(F.count("*").alias("n_errors"))


def error_share(spans: DataFrame) -> DataFrame:
    """One row: traces, those with an error, and their percentage."""
    own = flagged(spans).groupBy("trace_id").agg(F.bool_or(F.col("_bad") | F.col("_err")).alias("_failed"))
    return own.agg(F.count("*").alias("num_traces"), F.count_if("_failed").alias("num_failed"), F.round(100 * F.count_if("_failed") / F.count("*"), 6).alias("percentage"))


def reference_check(spans: DataFrame) -> DataFrame:
    """spans: num_refs, how many references a span has. Per trace, the spans with none and those with several; traces where all but one have one are fine."""
    n = F.col("num_refs")
    return spans.groupBy("trace_id").agg(F.count_if(n == 0).alias("n_without"), F.count_if(n > 1).alias("n_several"), (F.count_if(n != 1) == 1).alias("fine"))


def snapshot_summary(traces: DataFrame) -> DataFrame:
    """Counts and, for spans, duration and time to respond, least, mean (whole part) and most."""
    three = [f(c).alias(f"{n}_{c}") for c in ("num_spans", "duration_us", "time_to_respond_us") for n, f in (("min", F.min), ("avg", lambda x: F.floor(F.sum(x) / F.count(x))), ("max", F.max))]
    return traces.agg(F.count("*").alias("num_traces"), F.countDistinct("file_id").alias("num_files"), F.countDistinct("endpoint").alias("num_endpoints"), F.count_if(F.col("num_missing") > 0).alias("num_incomplete"), *three)


def expected_roots(keyed: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """For each chain that isn't rooted: the most frequent root call of its traces (ties: the one seen first)."""
    own = _of_traces(keyed.where("NOT rooted"), traces, "root_call")
    n = own.groupBy("chain_key", "root_call").agg(rows(own).alias("n"), F.min("seen" if "seen" in own.columns else F.struct("trace_id", "span_idx")).alias("seen"))
    return n.groupBy("chain_key").agg(F.min(F.struct((-F.col("n")).alias("n"), "seen", "root_call"))["root_call"].alias("expected_root"))


def known_chains(keyed: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """endpoint, call_chain, is_leaf of the rooted chains of complete traces."""
    own = _of_traces(keyed.where("rooted"), traces, "num_missing", "endpoint")
    return own.where("num_missing = 0").select("endpoint", "call_chain", "is_leaf").distinct()


def merge_known(known: DataFrame, new: DataFrame) -> DataFrame:
    """known and those of new that it doesn't have."""
    return known.unionByName(new).distinct()


def repair_chains(broken: DataFrame, known: DataFrame) -> DataFrame:
    """broken: chain_key, endpoint, call_chain, caching_process, is_leaf. Where exactly one known chain of the endpoint ends with a broken one it is adopted;
    of two, the one of equal is_leaf, else the last. The caching label stays. Suffixes are exploded and pre-aggregated: of each, how many known
    chains end so and the last of either kind. So the match is an equi join with a row per suffix, however many chains share it."""
    suffixes = known.select(F.col("endpoint").alias("_endpoint"), F.col("call_chain").alias("full"), F.col("is_leaf").alias("full_leaf"), F.explode(F.transform(F.sequence(F.lit(1), F.size("call_chain")), lambda i: F.slice("call_chain", i, F.size("call_chain")))).alias("suffix"))
    last = F.struct(F.array_join(F.transform("full", S.call_text), " | ").alias("text"), "full", "full_leaf")
    ends = suffixes.groupBy("_endpoint", "suffix").agg(F.count("*").alias("matches"), F.max(F.when(F.col("full_leaf"), last)).alias("_leaf"), F.max(F.when(~F.col("full_leaf"), last)).alias("_inner")).where("matches <= 2")
    own = broken.dropDuplicates(["chain_key", "endpoint"])
    hits = own.join(ends, (F.col("endpoint") == F.col("_endpoint")) & (F.col("call_chain") == F.col("suffix")))
    best = hits.select("chain_key", "endpoint", "matches", F.col("caching_process").alias("caching"), F.when(F.col("is_leaf"), F.coalesce("_leaf", "_inner")).otherwise(F.coalesce("_inner", "_leaf")).alias("best"))
    new = S.chain_key(F.col("best.full"), F.col("caching"), F.col("best.full_leaf"))
    return best.select("chain_key", "endpoint", "matches", new.alias("new_key"), F.col("best.full").alias("new_chain"), F.col("best.full_leaf").alias("new_leaf"))
