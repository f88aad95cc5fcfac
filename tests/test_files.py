"""Commands, reports, record forms and the stream, on small hand-made traces."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill import cli
from tracemill.operators import graph as G
from tracemill.operators import spans as sp
from tracemill.operators import stats as st
from tracemill.plans.viewer import Viewer
from tracemill.sources import jaeger, snapshots
from tracemill.streaming import sessions


def span(trace, i, parent, service, start, lost=False):
    refs = [{"refType": "CHILD_OF", "traceID": trace, "spanID": parent}] if parent else []
    return {"traceID": trace, "spanID": i, "operationName": f"op{service}", "references": refs, "startTime": start, "duration": 1000 + start % 7, "tags": [{"key": "span.kind", "type": "string", "value": "server"}], "logs": [], "processID": f"p{service}"}


def trace(name, at, lost=False):
    spans = [span(name, "a", None, "A", at), span(name, "b", "a", "B", at + 10), span(name, "c", "b", "C", at + 20)]
    if lost:
        spans.pop(1)
    return {"traceID": name, "spans": spans, "processes": {f"p{s}": {"serviceName": s, "tags": []} for s in "ABC"}}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("traces")
    for day in range(2):
        (d / f"in{day}").mkdir()
        data = [trace(f"t{day}-{i}", 10**12 + day * 10**10 + i * 1000, lost=i == 5) for i in range(6)]
        (d / f"in{day}" / "x.json").write_text(json.dumps({"data": data, "total": 0, "limit": 0, "offset": 0}))
    return d


def test_commands(spark, folder, capsys):
    cli.main(["trace_analysis", str(folder / "in0"), "-o", str(folder / "out0"), "-t", "-z", "60"])
    s = spark.read.parquet(str(folder / "out0/snapshot")).first()
    assert (s.num_traces, s.num_incomplete_traces, s.init_num_unrooted_cc, s.num_fixes, s.num_unrooted_cc_after_fixes, s.num_call_chains) == (6, 1, 1, 1, 0, 4)  # A, A as a leaf, A to B, A to C
    c = {r.chain_key: r for r in spark.read.parquet(str(folder / "out0/chain_stats")).collect()}
    whole = [r for k, r in c.items() if k.count("|") == 2]
    assert len(whole) == 1 and whole[0]["count"] == 6 and whole[0].repaired and whole[0].rooted
    text = (folder / "out0/statistics.csv").read_text()
    assert "num_fixes:; 1" in text and "C; opC; 6; 6;" in text and "start:; 1970-01-12 14:46:40.000" in text  # 10^12 µs, an hour east
    e = spark.read.parquet(str(folder / "out0/endpoint_summary")).collect()
    assert [(r.num_traces, r.num_incomplete_traces, r.init_num_unrooted_cc, r.num_fixes, r.num_call_chains) for r in e] == [(6, 1, 1, 1, 4)]
    e = {(r.endpoint, r.service, r["count"]) for r in spark.read.parquet(str(folder / "out0/endpoint_oper_stats")).collect()}
    assert len({x[0] for x in e}) == 1 and ("C", 6) in {x[1:] for x in e}
    texts = [r[0] for r in spark.read.text(str(folder / "out0/Traces"), wholetext=True).select("value").collect()]
    assert sum("\n      C/opC {" in x for x in texts) == 5 and sum("\n  C/opC {" in x for x in texts) == 1  # the lost span's child has no path to the root
    (folder / "list.stitch").write_text("# days\nout0\n% gap\nout0 # second\n")
    cli.main(["stitch", str(folder / "list.stitch"), "-o", str(folder / "st")])
    y = {(r.x, r.y) for r in spark.read.parquet(str(folder / "st/operations")).where("service = 'C' AND metric = 'count'").collect()}
    assert y == {(0, 6.0), (2, 6.0)} and "0 anomalies" in capsys.readouterr().out
    report = (folder / "st/stitched.csv").read_text().split("\n")
    heads = [line for line in report if line.startswith("## ")]
    assert len(heads) == 9 and all(report[int(line.split("@ row ")[1].split(":")[0]) - 1].startswith("## ") for line in report[3:12])
    v = Viewer.from_folder(spark, str(folder / "out0"))
    lists = {r.chain_key.count("|"): (r["count"], r.chain_type, r.idx) for r in v.chain_list("C", operation="opC").collect()}
    assert not v.is_time_series and lists[2] == (6, "end2end", 1) and v.chain_list("C", operation="none").count() == 0
    passing = v.chain_list("B", "all").collect()
    assert len(passing) == 1 and passing[0].inbound_idx == 1 and v.chain_list("B", "all", inbound_idx=2).count() == 0
    w = Viewer.from_folder(spark, str(folder / "st"))
    assert w.is_time_series and w.columns == 3 and w.chain_list("C").first()["count"] == 12
    assert "A/opA -->|10| B/opB" in w.diagram("B") and "A/opA -->|5| B/opB" in v.diagram("B")
    with pytest.raises(FileNotFoundError):
        Viewer.from_folder(spark, str(folder / "in0"))
    cli.main(["mermaid", str(folder / "st"), "-s", "B/opB", "-o", str(folder / "mm")])
    assert (folder / "mm/diagram.mmd").read_text().split("\n")[3] == "graph LR"
    cli.main(["show_traces", str(folder / "in0"), "-o", str(folder / "show"), "-t", "t0-1"])
    again = json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(str(folder / "show/Traces")).collect()))
    assert again["data"][0]["traceID"] == "t0-1" and len(again["data"][0]["spans"]) == 3


def test_diagram(spark, folder):
    spans = jaeger.to_spans(jaeger.read_traces(spark, str(folder / "in0")))[0].where("trace_id <> 't0-5'")
    keyed = st.with_keys(sp.with_paths(spans))
    chain = keyed.where("service = 'C'").first().chain_key
    edges = G.service_graph(G.chain_table(keyed, False), G.paths(keyed), "B", "opB", chain)
    got = {(r.from_service, r.to_service): r for r in edges.collect()}
    assert (got["A", "B"].link_type, got["A", "B"]["count"], got["B", "C"].inbound_count) == ("Emphasized", 5, 5)
    assert {r.service: r.position for r in G.positions(edges).collect()} == {"A": "InboundCenter", "B": "Center", "C": "OutboundCenter"}
    v = Viewer(spans, keyed, 1)
    text = v.diagram("B", "opB", chain)
    assert text.startswith("---\ntitle: B/opB (metric=count)\n---\ngraph LR") and "A/opA ==>|5/5| B/opB" in text and "linkStyle 0,1 stroke:#3333ff" in text
    small = v.diagram("B", scope="inbound", compact=True)
    assert "A -->|5| B" in small and "C" not in small.split("graph LR")[1]
    with pytest.raises(ValueError):
        v.diagram("B", metric="num_files")


def test_records(spark, tmp_path):
    line = {"label": "min_millis", "data": [1.0, None, 3.0], "num_filled_columns": 2, "best_fit": "None"}
    old = {"sources": [{"column": 0, "description": "d"}], "basic": [line], "process_operation": [["S/op/x", [line]]], "call_chain": [["S/op/x", [{"full_key": "S/op/x & & ", "inboud_process_key": "S/op/x", "rooted": True, "is_leaf": False, "data": [{**line, "label": "rate (avg)"}]}]]]}
    (tmp_path / "old.json").write_text(json.dumps(old))
    got = snapshots.read_stitched_record(spark, str(tmp_path / "old.json"))
    assert [tuple(r) for r in got["operations"].orderBy("x").collect()] == [("S", "op/x", "minimal duration millis", 0, 1.0), ("S", "op/x", "minimal duration millis", 2, 3.0)]
    assert {r.metric for r in got["chains"].collect()} == {"rate (req/sec)"} and got["chain_info"].first().inbound_key == "S/op/x" and got["columns"].first()[0] == 3
    value = {"count": 1, "depth": 1, "duration_micros": [5], "start_dt_micros": [7], "looped": [], "rooted": True}
    record = {"trace_id": ["t"], "root_call": ["S/op"], "num_spans": [1], "start_dt": [7], "end_dt": [12], "duration_micros": [5], "time_to_respond_micros": [5], "num_files": 1, "stats": {"S": {"method": {"op": {**value, "num_traces": 1}}, "num_traces": 1, "num_received_calls": 1, "num_outbound_calls": 0, "num_unknown_calls": 0, "call_chain": [[{"call_chain": [{"process": "S", "method": "op"}], "caching_process": "", "is_leaf": True}, value]]}}}
    (tmp_path / "r.json").write_text(json.dumps(record))
    r = snapshots.read_snapshot_record(spark, str(tmp_path / "r.json"))
    assert r["traces"].first().root_call == "S/op" and r["durations"].first().duration_us == [5] and r["service_stats"].first().num_received == 1
    assert r["chains"].first().chain_key == "S/op & &  *LEAF*"


def test_stream(spark, folder, tmp_path):
    x = sessions.read_span_stream(spark, str(folder / "in*"), "1 minute")
    for name, df in (("closed", sessions.closed_traces(x, "1 minute")), ("stats", sessions.windowed_stats(x, "1 hour"))):
        q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    closed = {r.trace_id: r for r in spark.read.parquet(str(tmp_path / "closed")).collect()}
    assert closed["t0-0"].num_spans == 3 and closed["t0-0"].root_call == "A/opA" and closed["t0-5"].num_spans == 2
    assert spark.read.parquet(str(tmp_path / "stats")).where("service = 'C'").agg(F.max("count")).first()[0] == 6
