"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs once to warm up and then three times; the median is reported.
A run executes the whole plan into Spark's ``noop`` sink, so no rows travel to the
driver. Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from metricslake.queries import QUERIES  # noqa: E402
from metricslake.session import build_session  # noqa: E402

HEADLINE = [
    "benchmark_geomean",
    "benchmark_query_times",
    "geomean_report",
    "version_baselines",
    "query_times_report",
    "run_jobs",
    "wait_times",
    "daily_runs",
    "runtime_by_runner",
    "runtime_by_job",
    "top_n_downloads",
    "top_n_weekly_pivot",
    "top_n_cumulative_pivot",
    "raw_downloads",
    "completed_prefix",
    "contiguity_gate",
    "budgeted_work",
    "upsert_changed",
    "snapshot_changes",
    "unpivot_download_counts",
]

REPEATS = 3


def run_once(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, app_name="metricslake-bench")
    results = {}
    for name in names:
        run_once(spark, name, sf_dir)  # warm-up
        results[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(REPEATS)), 4)
    spark.stop()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "sum_of_median_query_seconds",
                "value": round(sum(results.values()), 4),
                "unit": "sec",
                "queries": results,
                "sf": float(m.group(1)) if m else sf_dir,
                "cpus": cpus,
                "repeats": REPEATS,
            }
        )
    )


if __name__ == "__main__":
    main()
