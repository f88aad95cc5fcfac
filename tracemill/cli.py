"""python -m tracemill.cli COMMAND: trace_analysis, stitch, show_traces, mermaid, dotgraph."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .operators import graph
from .operators import snapshot as sn
from .operators import spans as sp
from .operators import stats as st
from .plans.viewer import Viewer
from .sources import jaeger, reports, snapshots


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracemill", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("trace_analysis", help="a snapshot of trace files: tables, statistics and issues")
    a.add_argument("--caching-process", default="")
    a.add_argument("-c", "--decimal-point", action="store_true")
    a.add_argument("-k", "--known-chains", help="folder of known chains of earlier runs, to which this run's are added")
    a.add_argument("-f", "--form", choices=["parquet", "json"], default="parquet")
    a.add_argument("-z", "--timezone-minutes", type=int, default=0, help="offset from UTC of times in reports")
    a.add_argument("-t", "--trace-texts", action="store_true", help="each trace as text too")
    s = sub.add_parser("stitch", help="series, report and anomalies of listed snapshots")
    s.add_argument("-d", "--drop-count", type=int, default=0)
    s.add_argument("-c", "--decimal-point", action="store_true")
    for name, bound in (("slope", 0.05), ("st-slope", 0.05), ("deviation", 2.0)):
        s.add_argument(f"--{name}", type=float, default=bound)
    t = sub.add_parser("show_traces", help="traces as JSON, a folder each")
    t.add_argument("-t", "--trace-ids", default="")
    m = sub.add_parser("mermaid", help="a diagram of the calls around a service")
    m.add_argument("-s", "--service-oper", required=True)
    m.add_argument("-e", "--edge-value", default="count")
    m.add_argument("--call-chain")
    m.add_argument("--scope", choices=sorted(graph.SCOPES), default="full")
    m.add_argument("--compact", action="store_true")
    sub.add_parser("dotgraph", help="calls per service, direction and operation")
    for x in sub.choices.values():
        x.add_argument("input")
        x.add_argument("-o", "--output", default="out")
    return p


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "stitch":
        lines = Path(a.input).read_text(encoding="utf-8").splitlines()
        sources = jaeger.stitch_list(lines, str(Path(a.input).parent))
        paths = [path for column, _, path in sources if column is not None]
        found = {k: _written(v, f"{a.output}/{k}") for k, v in snapshots.stitch(spark, paths, a.drop_count).items()}
        reports.stitched_csv(found, sources, len(paths), f"{a.output}/stitched.csv", not a.decimal_point)
        n = reports.anomalies_csv(found, len(paths), f"{a.output}/anomalies.csv", slope=a.slope, st_slope=a.st_slope, deviation=a.deviation)
        print(f"{n} anomalies")
        return
    service, _, operation = getattr(a, "service_oper", "").partition("/")
    if a.command == "mermaid" and (jaeger.exists(spark, f"{a.input}/operations") or jaeger.exists(spark, f"{a.input}/oper_stats")):
        text = Viewer.from_folder(spark, a.input).diagram(service, operation or None, a.call_chain, a.edge_value, a.scope, a.compact)
        Path(a.output).mkdir(parents=True, exist_ok=True)
        (Path(a.output) / "diagram.mmd").write_text(text, encoding="utf-8")
        print(text)
        return
    traces, again = sp.dedup_traces(jaeger.read_traces(spark, a.input), ["file_id", "trace_pos"])
    if a.command == "show_traces":
        snapshots.write_traces(traces, f"{a.output}/Traces", a.trace_ids)
        return
    spans, issues = jaeger.to_spans(traces)
    if a.command == "trace_analysis":
        caching = [x for x in a.caching_process.split(",") if x]
        kept = jaeger.chain_folder(a.known_chains, caching) if a.known_chains else None
        known = jaeger.read_known(spark, kept).drop("caching_process") if kept and jaeger.exists(spark, kept) else None
        spans = _written(spans, f"{a.output}/clean")
        tables = sn.analyse(spans, caching, known, lambda df, name: _written(df, f"{a.output}/{name}"))
        snapshots.write_snapshot(tables, a.output, a.form)
        reports.statistics_csv(tables, f"{a.output}/statistics.csv", not a.decimal_point, a.timezone_minutes)
        if a.trace_texts:
            snapshots.write_trace_texts(spark.read.parquet(f"{a.output}/paths"), tables["traces"], f"{a.output}/Traces")
        if kept:
            jaeger.write_chains(spark.read.format(a.form).load(f"{a.output}/known_chains"), kept)
        reports.issues_report({"Spans": issues, "Traces that came again": again}, f"{a.output}/report.txt")
        return
    keyed = st.with_keys(sp.with_paths(spans))
    if a.command == "dotgraph":
        for line in reports.table(graph.process_nodes(keyed), ["service", "direction", "operation"]):
            print(line)
        return
    print(Viewer(spans, keyed, 1).diagram(service, operation or None, a.call_chain, a.edge_value, a.scope, a.compact))


if __name__ == "__main__":
    main()
