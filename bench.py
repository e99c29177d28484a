"""Benchmark the headline reports.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and forces full execution through the ``noop`` sink
(every row is produced, nothing is collected to the driver).  Each query runs
``$BENCH_REPEAT`` times (default 5) after ``$BENCH_WARMUP`` warm-up passes
over all queries (default 2: JIT compilation of the planner and codegen
paths, file listing); the median is reported.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mercato.plans.registry import QUERIES  # noqa: E402
from mercato.session import build_session  # noqa: E402

HEADLINE = ("sales_report", "shipments_report", "stock_snapshot", "stock_report")
SECONDARY = ("stock_latest_per_day", "stock_forward_fill", "stock_forward_fill_fused",
             "sales_extract", "shipments_extract", "stock_extract")


def _run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "5"))
    warmup = int(os.environ.get("BENCH_WARMUP", "2"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    names = HEADLINE + SECONDARY
    for _ in range(warmup):
        for name in names:
            _run(spark, name, sf_dir)
    per_query = {}
    for name in names:
        per_query[name] = round(statistics.median(_run(spark, name, sf_dir) for _ in range(repeat)), 4)
    spark.stop()
    match = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_reports_total",
        "value": round(sum(per_query[n] for n in HEADLINE), 4),
        "unit": "sec",
        "queries": per_query,
        "sf": float(match.group(1)) if match else sf_dir,
        "cpus": int(cpus),
        "repeat": repeat,
    }))


if __name__ == "__main__":
    main()
