"""Reports in one text file, written by the driver from ordered tables that stream to it: statistics, stitched series, anomalies and issues.

The tables themselves are the scalable form; these files are for reading, and grow with the number of operations and chains, not of spans.
"""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import snapshot as sn
from ..operators import stitch as R


class Sections:
    """Lines with titled sections, and a table of contents on top that names each section's row."""

    def __init__(self):
        self.lines: list[str] = []
        self.contents: list[tuple[int, str]] = []

    def section(self, title: str, header: str = "", rows: Iterable[str] = ()) -> None:
        self.lines += ["", "", f"## {title}"]
        self.contents.append((len(self.lines), title))
        self.lines += [header] * bool(header)
        self.lines += rows

    def text(self) -> str:
        own = ["", "", "Table of Contents of this file (starting rows of sections):"]
        above = len(own) + len(self.contents)
        own += [f"{i:3} @ row {row + above}: {title}" for i, (row, title) in enumerate(self.contents, 1)]
        return "\n".join(own + self.lines)

    def write(self, path: str) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(self.text(), encoding="utf-8")


def _cell(v, comma: bool) -> str:
    if v is None:
        return "--"
    if isinstance(v, float):
        return f"{v:.6f}".replace(".", ",") if comma else f"{v:.6f}"
    return str(v)


def rows(df: DataFrame, comma: bool = True) -> Iterable[str]:
    """A line per row, in order, cells parted by semicolons."""
    return ("; ".join(_cell(v, comma) for v in r) for r in df.toLocalIterator())


def table(df: DataFrame, order: list[str], comma: bool = True) -> list[str]:
    return ["; ".join(df.columns), *rows(df.orderBy(*order), comma)]


def statistics_csv(tables: dict[str, DataFrame], path: str, comma: bool = True, offset_minutes: int = 0) -> None:
    """Four parts: the whole set, services, operations, chains. Columns are named by what they hold. offset_minutes: from UTC, of start and end as text."""
    whole = ("num_spans", "duration_us", "time_to_respond_us")
    three = [f(c).alias(f"{n}({c})") for c in whole for n, f in (("MIN", F.min), ("AVG", lambda x: F.floor(F.sum(x) / F.count(x))), ("MAX", F.max))]
    t = tables["traces"].agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), *[S.datetime_text(f(c), offset_minutes, True).alias(n) for n, c, f in (("start", "start_us", F.min), ("end", "end_us", F.max))], *three).first().asDict()
    lines = [f"{k}:; {_cell(v, comma)}" for k, v in {**tables["snapshot"].first().asDict(), **t}.items()]
    roots = tables["traces"].groupBy("root_call").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "root_call")
    lines += [f"root_call:; {r}" for r in rows(roots, comma)]
    chains = tables["chain_stats"].select("chain_key", "cc_hash", "endpoint", "leaf", "is_leaf", "rooted", "repaired", "depth", "count", "loops", "caching_process", *MEASURES, "expect_contribution")
    parts = [lines, table(tables["service_stats"], ["service"], comma), table(tables["oper_stats"].select("service", "operation", "count", "num_traces", *MEASURES), ["service", "operation"], comma), table(chains, ["chain_key"], comma)]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n\n\n".join("\n".join(p) for p in parts) + "\n", encoding="utf-8")


MEASURES = ["min_ms", "median_ms", "avg_ms", "max_ms", "p75_ms", "p90_ms", "p95_ms", "p99_ms", "occurrence", "avg_rate", "expect_duration", "frac_not_http_ok", "frac_error_logs"]
FITS = ["best_fit", "slope", "intercept", "r2", "l1", "scaled_slope", "last_deviation_scaled", "growth", "exp_a", "exp_b", "exp_r2", "last_exp_deviation"]


def _wide(fitted: DataFrame, keys: list[str], value: str, metrics: tuple[str, ...], counts: bool) -> DataFrame:
    """A row per key with a column per metric; with counts: mean and filled columns of the first metric before them."""
    first = F.col("metric") == metrics[0]
    more = [F.max(F.when(first, F.col("avg"))).alias("mean count"), F.max(F.when(first, F.col("num_filled"))).alias("num_filled")] if counts else []
    return fitted.groupBy(*keys).agg(*more, *[F.max(F.when(F.col("metric") == m, F.col(value))).alias(m) for m in metrics])


def full_lines(series: DataFrame, fitted: DataFrame, keys: list[str], columns: int, metrics: tuple[str, ...]) -> DataFrame:
    """keys, metric, num_filled, a column per snapshot, and the fit; in report order."""
    own = [*keys, "metric"]
    data = series.groupBy(*own).agg(*[F.max(F.when(F.col("x") == i, F.col("y"))).alias(str(i)) for i in range(columns)])
    x = data.join(fitted.select(*own, "num_filled", *FITS), own)
    return x.orderBy(*keys, sn.metric_order(metrics, F.col("metric"))).select(*own, "num_filled", *[F.col(f"`{i}`") for i in range(columns)], *FITS)


def stitched_csv(series: dict[str, DataFrame], sources: list[tuple], columns: int, path: str, comma: bool = True) -> None:
    """Nine sections: sources, four summaries of operations, whole snapshots, operations, and chains in short and in full."""
    out = Sections()
    out.section("Stitched files (numbered) and comments", rows=[f"{'' if i is None else i + 1}; {d}" for i, d, *_ in sources])
    fit = R.lines(series["operations"].withColumn("name", F.concat("service", F.lit("/"), "operation")), ["name", "metric"], columns)
    for title, value in (("Summary of operations", "avg"), ("Slopes of operations", "slope"), ("Scaled slopes of operations", "scaled_slope"), ("Scaled last deviations of operations", "last_deviation_scaled")):
        w = _wide(fit, ["name"], value, sn.OPERATION, value != "avg")
        out.section(title, "; ".join(w.columns), rows(w.orderBy("name"), comma))
    named = series["operations"].withColumn("name", F.concat("service", F.lit("/"), "operation"))
    basic = series["basic"].withColumn("name", F.lit("snapshots"))
    for title, s, metrics in (("Whole snapshots", basic, sn.BASIC), ("Operations", named, sn.OPERATION)):
        x = full_lines(s, R.lines(s, ["name", "metric"], columns), ["name"], columns, metrics)
        out.section(title, "; ".join(x.columns), rows(x, comma))
    info = series["chain_info"].withColumn("cc_hash", S.string_hash(F.col("chain_key")))
    chain_fit = R.lines(series["chains"], ["chain_key", "metric"], columns)
    w = info.join(_wide(chain_fit, ["chain_key"], "avg", sn.OPERATION, False).withColumnRenamed("count", "mean count"), "chain_key")
    w = w.orderBy("is_leaf", F.desc("count"), "chain_key").drop("count") if "count" in info.columns else w.orderBy("is_leaf", "chain_key")
    out.section("Summary of chains, by count", "; ".join(w.columns), rows(w, comma))
    x = full_lines(series["chains"], chain_fit, ["chain_key"], columns, sn.OPERATION)
    out.section("Chains", "; ".join(x.columns), rows(x, comma))
    out.write(path)


def anomalies_csv(series: dict[str, DataFrame], columns: int, path: str, **bounds: float) -> int:
    """How many anomalies there are; a file with a section per metric and level, only if there are any."""
    oper = R.lines(series["operations"].withColumn("key", F.concat("service", F.lit("/"), "operation")), ["key", "metric"], columns)
    chain = R.lines(series["chains"].withColumnRenamed("chain_key", "key"), ["key", "metric"], columns)
    out, n = Sections(), 0
    for level, fitted in (("operations", oper), ("chains", chain)):
        found: dict[str, list[str]] = {}
        for r in R.anomalies(fitted, **bounds).orderBy("metric", "key").toLocalIterator():
            found.setdefault(r["metric"], []).append("; ".join(_cell(r[c], True) for c in ("key", "scaled_slope", "scaled_st_slope", "last_deviation_scaled")))
        for m in sn.OPERATION:
            out.section(f"{m} ({level})", "key; scaled_slope; scaled_st_slope; last_deviation_scaled", found.get(m, []))
        n += sum(map(len, found.values()))
    if n:
        out.write(path)
    return n


def issues_report(chapters: dict[str, DataFrame], path: str) -> None:
    """chapter to a table of messages: a text with a section each."""
    out = Sections()
    for title, df in chapters.items():
        out.section(title, "; ".join(df.columns), rows(df.orderBy(*df.columns)))
    out.write(path)
