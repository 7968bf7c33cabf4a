"""Benchmark: wall time of the headline queries over whole tables, one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores. One untimed run
of the full analysis warms the JVM up; then every query runs once into a
sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from wireloom.plans import registry
from wireloom.session import local_session

HEADLINE = [
    "event_normalize",
    "whitelist_filter",
    "sessionize",
    "session_http_lists",
    "flow_features",
    "app_features",
    "impute_median",
    "balance_classes",
    "stratified_split",
    "baseline",
    "stat_score",
    "zero_byte_bursts",
    "ip_totals",
    "sliding_distinct",
    "behavior_scores",
    "behavior_features",
    "top_ips",
    "result_rows",
    "alert_text",
]


def run(build, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus, "wireloom-bench")
    names = sys.argv[1:] or HEADLINE
    if not sys.argv[1:]:
        run(registry.QUERIES["result_rows"], spark, sf_dir)
    times = {name: run(registry.QUERIES[name], spark, sf_dir) for name in names}
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "events": events,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
