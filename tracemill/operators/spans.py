"""Spans of traces: parents, leaves, call-chains, deduplication and trace records.

A span table has trace_id, span_idx (its order in the trace), span_id, parent_id, service, operation, call_direction, ...
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..functions import scalar as S


def dedup_traces(traces: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first row of each trace_id in the given order, and the ids that came again."""
    n = traces.withColumn("_n", F.row_number().over(Window.partitionBy("trace_id").orderBy(*order)))
    return n.where("_n = 1").drop("_n"), n.where("_n > 1").select("trace_id").distinct()


#: Traces of more spans than this find parents by sorting, others by looking through the trace.
SEARCHED = 64
#: Sorted keys and references of a trace, each with the place (d) of the first span of its key, or 0: the head of a run of equal keys says it.
_RUNS = """transform(array(array_sort(concat(filter(transform(_keys, (k, i) -> named_struct('k', k, 'refers', false, 'a', i + 1)), x -> x.k is not null),
    filter(transform(_refs, (k, i) -> named_struct('k', k, 'refers', true, 'a', i + 1)), x -> x.k is not null)))), r -> transform(r, (x, i) -> named_struct(
    'p', if(i > 0 and x.k = r[greatest(i - 1, 0)].k, i, 0), 'd', if(x.refers, 0, x.a), 'refers', x.refers, 'a', x.a)))[0]"""


def _has_map(kind: DataType) -> bool:
    parts = [f.dataType for f in kind.fields] if isinstance(kind, StructType) else [kind.elementType] if isinstance(kind, ArrayType) else []
    return isinstance(kind, MapType) or any(map(_has_map, parts))


def gathered(spans: DataFrame, key: str, ref: str, keep: list[str]) -> DataFrame:
    """One row per trace: _s (struct(keep) of its spans in order of span_idx), and as parallel arrays _up, where the span that `ref` names by `key`
    stands (from 1; null where none is named, 0 where it is missing), and _leaf, whether no other span names it. Of equal keys the first counts.

    One shuffle by trace_id, and one array per trace. In short traces a parent is looked for among the keys; in longer ones keys and references are
    sorted together, so that finding parents is a sort and not a search per span."""
    own = list(dict.fromkeys(["span_idx", key, ref, *keep]))
    at = lambda x: F.struct(x["span_idx"])  # noqa: E731  a struct, since null indices have an order in one
    by_at = lambda a, b: F.when(at(a) < at(b), -1).when(at(a) > at(b), 1).otherwise(0)  # noqa: E731  maps have no order
    whole = F.collect_list(F.struct(*own))
    x = spans.groupBy("trace_id").agg((F.array_sort(whole, by_at) if _has_map(spans.select(*own).schema) else F.array_sort(whole)).alias("_s"))
    names = lambda s: F.when(F.coalesce(s[ref] != s[key], F.lit(True)), s[ref])
    x = x.withColumn("_keys", F.transform("_s", lambda s: s[key])).withColumn("_refs", F.transform("_s", names)).withColumn("_runs", F.when(F.size("_s") > SEARCHED, F.expr(_RUNS)))
    x = x.withColumn("_runs", F.when(F.col("_runs").isNotNull(), doubled("_runs", "'d', y.d, 'refers', x.refers, 'a', x.a")))
    sorted_up = """transform(array_sort(concat(transform(filter(_runs, x -> x.refers), x -> named_struct('a', x.a, 'u', x.d)),
        filter(transform(_refs, (k, i) -> if(k is null, named_struct('a', i + 1, 'u', cast(null as int)), null)), x -> x is not null))), x -> x.u)"""
    x = x.withColumn("_up", F.when(F.col("_runs").isNull(), F.expr("transform(_refs, r -> cast(array_position(_keys, r) as int))")).otherwise(F.expr(sorted_up)))
    sorted_leaf = """transform(array_sort(concat(transform(array_except(sequence(1, size(_s)), _up), i -> named_struct('a', i, 'leaf', true)),
        transform(filter(array_distinct(_up), u -> u > 0), u -> named_struct('a', u, 'leaf', false)))), x -> x.leaf)"""
    searched_leaf = F.expr("transform(_up, (u, i) -> not coalesce(array_contains(_up, i + 1), false))")
    return x.select("trace_id", "_s", "_up", F.when(F.size("_s") <= SEARCHED, searched_leaf).otherwise(F.expr(sorted_leaf)).alias("_leaf"))


def doubled(arr: str, own: str) -> Column:
    """An array of structs, each with p, where its parent stands (0 at an end), after paths have doubled along the parents until all have ended:
    `own` gives a struct's other fields from those of itself, x, and of its parent, y."""
    return F.expr(f"""aggregate(sequence(1, cast(ceil(log2(size({arr}) + 1)) as int) + 1), {arr}, (acc, i) -> if(exists(acc, x -> x.p > 0), transform(acc, x -> if(x.p = 0, x,
        transform(array(get(acc, x.p - 1)), y -> named_struct('p', y.p, {own}))[0])), acc))""")


def flagged(spans: DataFrame) -> DataFrame:
    """spans with _bad and _err: whether its HTTP status isn't 200, and whether it logged an error."""
    return spans.withColumns({"_bad": F.coalesce(S.http_not_ok(F.col("http_status_code")), F.lit(False)), "_err": F.coalesce(F.col("log_level") == "ERROR", F.lit(False))})


def _placed(g: DataFrame) -> DataFrame:
    """gathered() with _pos, the positions of a trace's spans."""
    return g.withColumn("_pos", F.transform("_up", lambda u: F.when(u.isNull(), "Root").when(u == 0, "MissingParent").otherwise("Parent")))


def _root() -> Column:
    """The first root span of what _placed() made."""
    return F.get(F.filter("_s", lambda s, i: F.get("_pos", i) == "Root"), F.lit(0))


def records(spans: DataFrame) -> DataFrame:
    """trace_records() of spans without paths: each record comes from its trace's array, and no paths are made."""
    g = _placed(gathered(spans, "span_id", "parent_id", ["service", "operation", "file_id", "start_us", "duration_us"]))
    g = g.withColumn("_roots", F.size(F.filter("_pos", lambda x: x == "Root"))).withColumn("_root", _root())
    of = lambda f: F.transform("_s", f)
    one = F.col("_roots") == 1
    return g.select(
        "trace_id", F.array_min(of(lambda s: s["file_id"])).alias("file_id"), F.size("_s").cast("long").alias("num_spans"), F.col("_roots").cast("long").alias("num_roots"),
        F.when(one, S.plain_call(F.col("_root"))).otherwise(F.lit(S.UNKNOWN_ROOT)).alias("root_call"),
        F.array_min(of(lambda s: s["start_us"])).alias("start_us"), F.array_max(of(lambda s: s["start_us"] + s["duration_us"])).alias("end_us"),
        F.when(one, F.col("_root")["duration_us"]).otherwise(F.get(F.filter("_s", lambda s: s["span_idx"].isNotNull()), F.lit(0))["duration_us"]).alias("time_to_respond_us"),
        F.size(F.filter("_pos", lambda x: x == "MissingParent")).cast("long").alias("num_missing"),
    ).withColumn("duration_us", F.col("end_us") - F.col("start_us")).withColumn("endpoint", S.endpoint_key(F.col("root_call")))


def with_paths(spans: DataFrame, of_trace: bool = False, errors: bool = False, chains: bool = True) -> DataFrame:
    """spans with position (Root, Parent, MissingParent), parent_idx, is_leaf, rooted and call_chain (root first); of_trace: with root_call, endpoint,
    num_roots and num_missing of its trace too, as trace_records() has them; errors: with path_bad and path_err, as operators.snapshot.path_errors().
    Without chains there are no rooted and call_chain, and spans of a cycle count as Parent.

    Each trace is gathered into one array; paths double in length by following parent pointers inside it, so the depth of a
    trace costs log2 rounds and there is one shuffle. No reference or one to itself: Root. A trace without exactly one root
    has no rooted span. A cycle of parents never ends and leaves its spans unresolved (position Cycle)."""
    rest = [c for c in spans.columns if c != "trace_id"]
    flags = ["_bad", "_err"] if errors else []
    g = _placed(gathered(flagged(spans) if errors else spans, "span_id", "parent_id", rest + flags))

    def start(x: Column, i: Column) -> Column:
        call = F.struct(x["service"].alias("service"), x["operation"].alias("operation"), x["call_direction"].alias("call_direction"))
        return F.struct(F.coalesce(F.get("_up", i), F.lit(0)).alias("p"), F.get("_pos", i).alias("end"), F.array(call).alias("chain"), *[x[f].alias(f) for f in flags])

    both = "".join(f", '{f}', x.{f} or y.{f}" for f in flags)
    if chains:
        g = g.withColumn("_a", F.transform("_s", start)).withColumn("_a", doubled("_a", f"'end', y.end, 'chain', concat(y.chain, x.chain){both}"))
    g = g.withColumn("_roots", F.size(F.filter("_pos", lambda x: x == "Root")))
    trace = {}
    if of_trace:
        g = g.withColumn("_call", F.when(F.col("_roots") == 1, S.plain_call(_root())).otherwise(F.lit(S.UNKNOWN_ROOT))).withColumn("_lost", F.size(F.filter("_pos", lambda x: x == "MissingParent")))
        trace = {"root_call": F.col("_call"), "endpoint": S.endpoint_key(F.col("_call")), "num_roots": F.col("_roots").cast("long"), "num_missing": F.col("_lost").cast("long")}
    g = g.withColumn("_up", F.transform("_up", lambda u: F.when(u > 0, F.get("_s", u - 1)["span_idx"])))
    g = g.select("trace_id", "_roots", *(["_call", "_lost"] if of_trace else []), F.explode(F.arrays_zip("_s", *(["_a"] if chains else []), "_pos", "_up", "_leaf")).alias("_x"))
    a = F.col("_x._a")
    ended = [((F.col("_roots") == 1) & (a["p"] == 0) & (a["end"] == "Root")).alias("rooted"), a["chain"].alias("call_chain")] if chains else []
    return g.select(
        "trace_id", *[F.col("_x._s")[c].alias(c) for c in rest],
        (F.when(a["p"] > 0, "Cycle").otherwise(F.col("_x._pos")) if chains else F.col("_x._pos")).alias("position"), F.col("_x._up").alias("parent_idx"), F.col("_x._leaf").alias("is_leaf"), *ended,
        *[v.alias(k) for k, v in trace.items()], *([a["_bad"].alias("path_bad"), a["_err"].alias("path_err")] if errors else []),
    )


def trace_records(spans: DataFrame) -> DataFrame:
    """One row per trace of spans with_paths() made: root call, times, response time, spans whose parent is missing."""
    root = F.col("position") == "Root"
    call = F.concat("service", F.lit("/"), "operation")
    one = F.count_if(root) == 1
    return spans.groupBy("trace_id").agg(
        F.min("file_id").alias("file_id"), F.count("*").alias("num_spans"), F.count_if(root).alias("num_roots"),
        F.when(one, F.max(F.when(root, call))).otherwise(F.lit(S.UNKNOWN_ROOT)).alias("root_call"),
        F.min("start_us").alias("start_us"), F.max(F.col("start_us") + F.col("duration_us")).alias("end_us"),
        F.when(one, F.max(F.when(root, F.col("duration_us")))).otherwise(F.min_by("duration_us", "span_idx")).alias("time_to_respond_us"),
        F.count_if(F.col("position") == "MissingParent").alias("num_missing"),
    ).withColumn("duration_us", F.col("end_us") - F.col("start_us")).withColumn("endpoint", S.endpoint_key(F.col("root_call")))
