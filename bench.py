"""Runs headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tracemill.plans import registry

NAMES = ["oper_stats", "service_stats", "trace_summary", "call_chain", "chain_stats", "chain_repair", "rate", "stitch_oper", "anomalies", "graph_edges", "stitch_chain_metrics", "graph_service", "chain_errors"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["service_stats"](spark, sf).write.format("noop").mode("overwrite").save()  # starts what a session starts once
    found = {}
    for name in NAMES:
        began = time.time()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        found[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": sf}))


if __name__ == "__main__":
    main()
