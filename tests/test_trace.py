"""Queries against their SQL, and operators on small hand-made traces."""

import json
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tracemill.functions import scalar as S
from tracemill.functions import timestats as T
from tracemill.operators import chaincount
from tracemill.operators import snapshot as sn
from tracemill.operators import spans as sp
from tracemill.operators import stats as st
from tracemill.operators import stitch as R
from tracemill.plans import registry
from tracemill.plans.viewer import Metric, Viewer
from tracemill.sources import jaeger

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "orders lineitem events documents".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in values)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def chain(spark, spec):
    """spec: (trace, idx, id, parent, service)."""
    x = spark.createDataFrame([(*s, "op", "Unknown", 0, 10 * i, 5) for i, s in enumerate(spec)], "trace_id string, span_idx int, span_id string, parent_id string, service string, operation string, call_direction string, file_id int, start_us long, duration_us long")
    return {(r.trace_id, r.span_id): r for r in sp.with_paths(x).collect()}


def test_paths_of_odd_traces(spark):
    got = chain(spark, [("t", 0, "a", "a", "A"), ("t", 1, "b", "a", "B"), ("t", 2, "c", "b", "A"), ("two", 0, "a", None, "A"), ("two", 1, "b", None, "B"), ("lost", 0, "x", None, "A"), ("lost", 1, "y", "gone", "B"), ("loop", 0, "p", "q", "A"), ("loop", 1, "q", "p", "B")])
    assert [c.service for c in got["t", "c"].call_chain] == ["A", "B", "A"] and got["t", "c"].rooted and got["t", "c"].is_leaf and got["t", "c"].parent_idx == 1
    assert not got["two", "a"].rooted and not got["lost", "y"].rooted and got["lost", "x"].rooted
    assert got["lost", "y"].position == "MissingParent" and got["loop", "p"].position == "Cycle" and not got["loop", "p"].rooted


def test_paths_and_errors_by_brute_force(spark):
    """Random traces with lost, repeated and null ids, several roots and cycles, against a walk from each span to its end."""
    rng = random.Random(5)
    spec = []
    for t in range(60):
        n = rng.randint(1, 12)
        ids = [rng.choice([None, f"s{i}", f"s{i}", f"s{i}", f"s{rng.randint(0, n)}"]) for i in range(n)]
        for i in range(n):
            at = 3 * i + rng.randint(0, 2)
            spec.append((f"t{t}" if t else None, at, ids[i], rng.choice([None, "gone", *[f"s{rng.randint(0, n)}"] * 6]), f"v{i}", "op", "Unknown", rng.choice([200, 200, 500, None]), rng.choice([None, "ERROR", "INFO"]), {"k": str(i)}))
    x = spark.createDataFrame(spec, "trace_id string, span_idx int, span_id string, parent_id string, service string, operation string, call_direction string, http_status_code short, log_level string, attributes map<string,string>")
    got = {(r.trace_id, r.span_idx): r for r in sn.path_errors(sp.with_paths(x.repartition(3))).collect()}
    # joins lose null trace ids: those are compared without errors
    paths = {(r.trace_id, r.span_idx): r for r in sp.with_paths(x).collect()}
    assert len(paths) == len(spec) and len(got) == sum(s[0] is not None for s in spec)
    for trace in {s[0] for s in spec}:
        own = sorted((s for s in spec if s[0] == trace), key=lambda s: s[1])
        first = {}
        for i, s in enumerate(own):
            first.setdefault(s[2], i)
        is_root = [s[3] is None or s[3] == s[2] for s in own]
        up = [None if is_root[i] else first.get(s[3]) for i, s in enumerate(own)]
        for i, s in enumerate(own):
            way = [i]
            while up[way[-1]] is not None and len(way) <= len(own):
                way.append(up[way[-1]])
            ended = len(way) <= len(own)
            r = paths[trace, s[1]]
            assert r.position == ("Cycle" if not ended else "Root" if is_root[i] else "MissingParent" if up[i] is None else "Parent")
            assert r.parent_idx == (None if up[i] is None else own[up[i]][1]) and r.is_leaf == (i not in up) and r.attributes == s[9]
            assert r.rooted == (ended and sum(is_root) == 1 and is_root[way[-1]])
            if ended:
                assert [c.service for c in r.call_chain] == [own[j][4] for j in reversed(way)]
                if trace is not None:
                    e = got[trace, s[1]]
                    assert (e.path_bad, e.path_err) == (any(own[j][7] == 500 for j in way), any(own[j][8] == "ERROR" for j in way))


def test_trace_of_50000_spans(spark):
    """Parents are found by sorting: a large trace costs its spans times their depth, not their square."""
    n = 50000
    x = spark.range(n).selectExpr(
        "'t' AS trace_id", "CAST(id AS int) AS span_idx", "concat('s', id) AS span_id", "IF(id = 0, NULL, concat('s', (id - 1) DIV 2)) AS parent_id", "concat('v', id % 7) AS service", "'op' AS operation",
        "'Unknown' AS call_direction", "CAST(IF(id = 1, 500, 200) AS short) AS http_status_code", "CAST(NULL AS string) AS log_level",
    )
    r = sn.path_errors(sp.with_paths(x)).agg(F.count("*"), F.count_if("rooted"), F.count_if("is_leaf"), F.max(F.size("call_chain")), F.count_if("path_bad")).first()
    below, level = 0, [1]  # spans under the second one, itself included
    while level:
        below += len(level)
        level = [c for p in level for c in (2 * p + 1, 2 * p + 2) if c < n]
    assert tuple(r) == (n, n, n // 2, 16, below)


@pytest.mark.parametrize(("us", "median", "p90"), [([6000, 1000, 2000], 2.0, None), ([1000, 2000, 3000, 6000], 2.5, None), ([1000 * i for i in range(1, 11)], 5.5, 9.0), ([1000 * i for i in range(1, 12)], 6.0, 10.0), ([1], None, None)])
def test_time_stats(spark, us, median, p90):
    r = T.cumulated(spark.createDataFrame([("k", x) for x in us], "k string, duration_us long"), ["k"], "duration_us").groupBy("k").agg(*T.time_stats()).first()
    assert (r.median_ms, r.p90_ms) == (median, p90)


@pytest.mark.parametrize(("ys", "slope", "intercept", "r2"), [([1, 1], 0, 1, 1), ([1, 1.1, 1], 0, 1.0333333, 0), ([1, 1, 1.1], 0.05, 0.9833333, 0.75), ([None, 2, 4, 6, None, 7], 1.2285714, 1.3714286, 0.8953995)])
def test_linear_fit(spark, ys, slope, intercept, r2):
    x = spark.createDataFrame([("k", i, None if y is None else float(y)) for i, y in enumerate(ys)], "key string, x int, y double")
    r = R.lines(x, ["key"], len(ys)).first()
    assert (r.slope, r["intercept"], r.r2) == pytest.approx((slope, intercept, r2), abs=1e-6)


def test_exponential_fit(spark):
    x = spark.createDataFrame([("k", i, float(y)) for i, y in enumerate([3, 7, 10, 24, 50, 95])], "key string, x int, y double")
    r = R.lines(x, ["key"], 6).first()
    assert (r.exp_a, r.exp_b, r.exp_r2, r.best_fit) == (pytest.approx(3.04645, abs=1e-4), pytest.approx(1.98803, abs=1e-4), pytest.approx(0.99301, abs=1e-4), "exponential")


def test_operation_names_and_labels(spark):
    x = spark.createDataFrame([("/a/T2023-01-02_12345/b",), ("/a/2023-01-02_12345",), ("/s/0a1b2c3d-0a1b-0a1b-0a1b-0a1b2c3d4e5f",), ("/v-123456-2023",), ("/acc/1234567",)], "op string")
    assert [r[0] for r in x.select(S.unify_operation(F.col("op"))).collect()] == ["/a/{TIME}/b", "/a/{TIME2}", "/s/{SAVINGS}", "/v-{VIEW}", "/acc/{ACCOUNT}"]
    for said, label in (("run 20230718 x", "July-18"), ("x 20230908", "Sept-8"), ("20240101", "Jan-1"), ("20241231 20240101", "Dec-31"), ("no day", "3")):
        assert spark.range(1).select(S.month_label(F.lit(said), F.lit(3))).first()[0] == label
    row = spark.createDataFrame([(1689678502462000,)], "us long").select(S.datetime_text(F.col("us")), S.datetime_text(F.col("us"), 120, True), S.datetime_micros(S.datetime_text(F.col("us"), -90), -90), S.datetime_text(F.col("us") * 0 - 1)).first()
    assert tuple(row) == ("2023-07-18 11:08:22.462000", "2023-07-18 13:08:22.462", 1689678502462000, "1969-12-31 23:59:59.999999")
    assert Metric.of("Rate (req/sec)") is Metric.RATE
    with pytest.raises(ValueError):
        Metric.of("none")


def _trace(name, parent):
    tag = [{"key": "http.status_code", "type": "int64", "value": 500}, {"key": "span.kind", "type": "string", "value": "server"}, {"key": "x", "type": "bool", "value": True}]
    span = lambda i, refs: {"traceID": name, "spanID": i, "operationName": "/é/1234567", "references": [{"refType": "CHILD_OF", "traceID": name, "spanID": r} for r in refs], "startTime": 1, "duration": 2, "tags": tag, "logs": [{"timestamp": 1, "fields": [{"key": "level", "type": "string", "value": "ERROR"}, {"key": "message", "type": "string", "value": "m" * 120}]}], "processID": "p1"}
    return {"traceID": name, "spans": [span("a", []), span("b", parent)], "processes": {"p1": {"serviceName": "svc", "tags": []}}}


def test_json_ingest_and_viewer(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": [_trace("t1", ["a"]), _trace("t2", ["a", "b"])], "total": 0}), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"data": [_trace("t1", ["a"]), _trace("t3", ["zz"])]}, ensure_ascii=False), encoding="utf-16")
    traces, again = sp.dedup_traces(jaeger.read_traces(spark, str(tmp_path)), ["file_id", "trace_pos"])
    spans, issues = jaeger.to_spans(traces)
    got = {(r.trace_id, r.span_id): r for r in spans.collect()}
    assert [r[0] for r in again.collect()] == ["t1"] and len(got) == 5 and [r.trace_id for r in issues.collect()] == ["t2"]
    r = got["t3", "a"]
    assert (r.service, r.operation, r.http_status_code, r.attributes, r.log_level) == ("svc", "/é/{ACCOUNT}", 500, {"x": "true"}, "ERROR")
    assert r.logs[0].msg == "m" * 100 + "...TRUNCATED"
    keyed = st.with_keys(sp.with_paths(spans))
    assert "graph LR" in Viewer(spans, keyed, 1).diagram("svc")
    assert jaeger.stitch_list(["# head", "% gap", "x/a.json # one", ""], "/b") == [(None, "head", None), (0, "gap", None), (1, "one", "/b/x/a.json")]


def test_repair_with_a_shared_suffix(spark):
    """A suffix that 10,000 known chains share repairs nothing, and costs one row; one that one or two have does."""
    call = lambda s: (s, "op", "Unknown")
    known = [("r", [call(f"a{i}"), call("z")], True) for i in range(10000)] + [("r", [call("b"), call("y")], True), ("r", [call("c"), call("x")], True), ("r", [call("d"), call("x")], False)]
    kind = "array<struct<service:string,operation:string,call_direction:string>>"
    broken = [(k, "r", [call(k)], "", leaf) for k, leaf in (("z", True), ("y", False), ("x", True), ("w", True))]
    got = st.repair_chains(spark.createDataFrame(broken, f"chain_key string, endpoint string, call_chain {kind}, caching_process string, is_leaf boolean"), spark.createDataFrame(known, f"endpoint string, call_chain {kind}, is_leaf boolean")).collect()
    assert {(r.chain_key, r.matches, r.new_key) for r in got} == {("y", 1, "b/op | y/op & &  *LEAF*"), ("x", 2, "c/op | x/op & &  *LEAF*")}


def test_chains_are_added(spark, tmp_path):
    """Labels stay, and what a folder has isn't written again."""
    kind = "endpoint string, call_chain array<struct<service:string,operation:string,call_direction:string>>, is_leaf boolean, caching_process string"
    a, b = ("e1", [("s", "o", "Inbound")], True, " [s]"), ("e2", [("s", "o/p", "Unknown"), ("t", "q", "Outbound")], False, "")
    path = jaeger.chain_folder(str(tmp_path / "known"), ["y", "x"])
    for rows in ([a], [a, b], [b]):
        jaeger.write_chains(spark.createDataFrame(rows, kind), path)
    got = {(r.endpoint, tuple(map(tuple, r.call_chain)), r.is_leaf, r.caching_process) for r in jaeger.read_known(spark, path).collect()}
    assert path.endswith("/x_y") and spark.read.text(path).count() == 2 and got == {(e, tuple(c), leaf, label.strip()) for e, c, leaf, label in (a, b)}


def test_chain_file_round_trip(spark, tmp_path):
    (tmp_path / "c.cchain").write_text("# known\n\ngw/GET:/x | a/op [Inbound] & &  *LEAF*\n")
    r = jaeger.read_chains(spark, str(tmp_path / "c.cchain")).first()
    assert [(c.service, c.operation, c.call_direction) for c in r.chain] == [("gw", "GET:/x", "Unknown"), ("a", "op", "Inbound")] and r.is_leaf and r.caching == ""


def test_long_traces_find_parents_as_short_ones_do(spark, monkeypatch):
    """Parents and leaves of random traces, with null, repeated and lost ids, are the same by sorting as by search; traces' columns and errors are those of the records and of path_errors."""
    rng = random.Random(9)
    spec = [(f"t{t}", i, rng.choice([None, f"s{i}", f"s{i}", f"s{rng.randint(0, n)}"]), rng.choice([None, "gone", *[f"s{rng.randint(0, n)}"] * 6]), f"v{i}", "op", "Unknown", rng.choice([200, 500, None]), rng.choice([None, "ERROR"]), 1, 10 * i, 5 + i)
            for t in range(50) for n in [rng.randint(1, 12)] for i in range(n)]
    x = spark.createDataFrame(spec, "trace_id string, span_idx int, span_id string, parent_id string, service string, operation string, call_direction string, http_status_code short, log_level string, file_id int, start_us long, duration_us long")
    found = []
    for most in (64, 0):
        monkeypatch.setattr(sp, "SEARCHED", most)
        found.append(sorted(map(str, sp.with_paths(x, of_trace=True, errors=True).collect())))
    assert found[0] == found[1]
    p = sp.with_paths(x, of_trace=True, errors=True)
    own = ["trace_id", "root_call", "endpoint", "num_roots", "num_missing"]
    assert sorted(map(str, sp.records(x).select(*own).collect())) == sorted(map(str, p.select(*own).distinct().collect()))
    columns = sp.trace_records(p).columns
    assert sorted(map(str, sp.records(x).select(*columns).collect())) == sorted(map(str, sp.trace_records(p).select(*columns).collect()))
    flags = p.where("position <> 'Cycle'").select("trace_id", "span_idx", "path_bad", "path_err")
    assert flags.count() == flags.intersect(sn.path_errors(sp.with_paths(x)).select(flags.columns)).count()


ONCE = "graph_service endpoint_oper_stats endpoint_chain_stats endpoint_service_stats inbound_prefix chain_fixes chain_repair graph_reachable graph_positions endpoint_summary known_chains_merged chain_parse_roundtrip chain_list_all chain_looped chain_errors snapshot_summary chain_type_counts chain_path_errors"


@pytest.mark.parametrize("name", ONCE.split())
def test_paths_are_made_once_of_what_is_used(spark, name):
    """Line items are read at most once by a plan (none where spans or chains were stored), and what a query doesn't use isn't gathered."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"FileScan parquet \[[^\]]*l_orderkey[^\n]*", plan))) <= 1 and "failed part " not in plan


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_metrics_of_chains_do_not_gather_spans_by_snapshot(spark):
    """Numbers of a snapshot come beside its rows: joined by snapshot, all spans of one lay in a task."""
    rows = [(f"t{i}", i % 3, i % 2, "c" if i % 5 else None, 1000 + i % 7, 1_000_000 * i, 200, None) for i in range(120)]
    x = spark.createDataFrame(rows, "trace_id string, file_id long, snapshot_id int, chain_key string, duration_us long, start_us long, http_status_code int, log_level string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = sn.series(x, x.select("snapshot_id", "trace_id", "file_id").distinct(), ["chain_key"])
        assert not re.search(r"SortMergeJoin \[[^\],]*snapshot_id#\d+[^\],]*\],", _plan(out))
        y = {(r["chain_key"], r["x"], r["metric"]): r["y"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert y[None, 0, "count"] == y[None, 1, "count"] == 12 and y["c", 0, "occurance percentage"] == 48 / 60
    assert y["c", 0, "rate (req/sec)"] == pytest.approx(44 / 104) and (None, 0, "rate (req/sec)") not in y  # three files: three gaps don't count, 15 starts are needed


def test_statistics_of_chains_shuffle_their_spans_once(spark):
    x = spark.createDataFrame([("e", "k", d, 1, True, True) for d in (5, 1, 3, None)] + [(None, None, 7, 2, False, False)], "endpoint string, chain_key string, duration_us long, depth int, is_leaf boolean, rooted boolean")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = st.chain_stats(x, ["endpoint"])
        assert _plan(out).count("ENSURE_REQUIREMENTS") <= 3  # all of rows that are counted before: buckets of keys, and keys
        rows = {r["chain_key"]: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(rows) == 2 and rows["k"]["count"] == 4 and rows["k"]["median_ms"] == 0.003 and rows["k"]["max_ms"] == 0.005
    assert rows[None]["endpoint"] is None and rows[None]["count"] == 1 and rows[None]["min_ms"] == 0.007


def test_large_tables_are_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    t, n = spark.read.parquet(str(tmp_path / "t")), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert T.dealt(t, "id").rdd.getNumPartitions() <= n
    monkeypatch.setattr(T, "TASK_BYTES", 200)
    d = T.dealt(t.where("id >= 0"), "id")
    assert d.rdd.getNumPartitions() > n and d.count() == 1000
    assert T.dealt(spark.createDataFrame([(1,)], "id long"), "id").count() == 1
    assert T.dealt(t.join(t.withColumnRenamed("id", "i"), F.col("id") == F.col("i")), "id").count() == 1000


def test_texts_without_hyphens_skip_rewrites_that_need_one(spark):
    ops = ["/api/123456/x", "/a-1/123456", "/x/T2024-01-02_12345/1234567", "/2024-01-02_12345", "/0123abcd-0123-0123-0123-0123abcd0999", "/" + "a" * 39 + "/", "/" + "b" * 40 + "=/y", "/" + "c" * 38 + "/", "/v-12345-2024", "", "/é/123456", None]
    want = []
    for op in ops:
        for pattern, name in S.REWRITES:
            op = None if op is None else re.sub(pattern, name, op)
        want.append(op)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ops)], "i int, op string").select("i", S.unify_operation(F.col("op")).alias("o"))
    assert [r["o"] for r in df.orderBy("i").collect()] == want
    assert all("-" in p for p, n in S.REWRITES if n not in ("/{BASE}/", "/{ACCOUNT}"))
    assert "CASE WHEN (Contains(op" in _plan(df)


def _spans_of(spark, spec):
    return spark.createDataFrame(spec, "trace_id string, span_idx int, span_id string, parent_id string, service string, operation string, call_direction string, http_status_code short, log_level string, file_id long")


def _as_counted(x, *by, **how):
    """What chaincount.counted() says, and the same by a row per span."""
    p = sp.with_paths(x, of_trace=True, errors=True)
    sums = {"path_bad": F.when(F.col("path_bad"), 1).otherwise(0), "path_err": F.when(F.col("path_err"), 1).otherwise(0), "statuses": F.col("http_status_code")}
    want = st.counted(p, *by, first=True, **sums)
    got = chaincount.counted(x, *by, first=True, errors=True, statuses=F.col("http_status_code"), **how)
    return [sorted(map(str, df.select(sorted(want.columns)).collect())) for df in (got, want)]


def test_counts_of_chains_are_those_of_their_spans(spark, monkeypatch):
    """Random traces with lost, repeated and null ids and texts, ties, several roots and cycles; traces that go over batches, and tasks that hold little."""
    rng = random.Random(11)
    texts = ["a", "b/;c", "", None, "x\x01\x02y", "\x03", "\x04d\x04a", "\u00e9"]
    spec = []
    for t in range(80):
        n = rng.choice([1, 2, 3, 5, 9, 70])
        for i in range(n):
            key = rng.choice([None, *[f"s{i}"] * 6, f"s{rng.randint(0, n)}"])
            ref = rng.choice([None, "gone", *[f"s{rng.randint(0, i)}"] * 9, f"s{rng.randint(0, n)}"]) if i else rng.choice([None, None, None, f"s{n - 1}"])
            spec.append((f"t{t % 77}" if t else None, rng.choice([3 * i, 3 * i, i // 2, None]), key, ref, rng.choice(texts), rng.choice(texts), rng.choice(["Unknown", "Inbound", None]), rng.choice([200, 200, 500, None]), rng.choice([None, "ERROR", "INFO"]), t % 3))
    x = _spans_of(spark, spec).repartition(3)
    for by in ((), ("endpoint", "root_call", "num_roots", "num_missing", "file_id")):
        got, want = _as_counted(x, *by)
        assert got == want
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for name, value in (("AT_ONCE", 20), ("HELD", 30), ("EMITTED", 4)):
            monkeypatch.setattr(chaincount, name, value)
        got, again = _as_counted(x, *by)
        assert got == again == want
        traces = spark.createDataFrame(chaincount.counted(x, "endpoint", of_trace="file_id", most={"num_missing": 1}).where("call_chain IS NULL").drop("call_chain").toArrow())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    own = sp.with_paths(x, of_trace=True).groupBy("trace_id", "endpoint").agg(F.min("file_id").alias("file_id"), F.least(F.max("num_missing"), F.lit(1)).alias("num_missing")).groupBy("endpoint", "file_id", "num_missing").count()
    assert sorted(map(str, traces.select(own.columns).collect())) == sorted(map(str, own.collect()))


def test_counts_of_chains_of_no_spans_and_of_a_deep_trace(spark):
    x = _spans_of(spark, [])
    assert chaincount.counted(x, "endpoint", of_trace="file_id").collect() == []
    deep = [("t", i, f"s{i}", f"s{i - 1}" if i else None, f"v{i % 3}", "op", "Unknown", None, None, 1) for i in range(1500)]
    got = chaincount.counted(_spans_of(spark, deep[::-1])).select("is_leaf", "rooted", F.size("call_chain"), "count").collect()
    assert sorted(map(tuple, got), key=lambda r: r[2]) == [(i == 1499, True, i + 1, 1) for i in range(1500)]


@pytest.mark.parametrize("name", "chain_repair graph_reachable graph_positions endpoint_summary known_chains_merged chain_parse_roundtrip chain_fixes chain_list_all graph_service chain_errors chain_path_errors inbound_prefix".split())
def test_counts_of_chains_have_no_row_per_span(spark, name, monkeypatch):
    """F8-F13: the step they share is done on arrays of spans, not by functions of each trace's records."""
    made = []
    monkeypatch.setattr(registry, "once", lambda df: made.append(df) or df)
    plans = [_plan(df) for df in (registry.QUERIES[name](spark, SF), *made)]
    assert any("MapInArrow" in p for p in plans) and not any("collect_list" in p for p in plans)
