"""Flag plan shapes that do not scale, for every registered query.

usage: python tools/plan_audit.py [--sf-dir DIR] [name ...]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from metricslake.queries import QUERIES  # noqa: E402
from metricslake.session import build_session  # noqa: E402

FLAGS = {
    "cartesian": r"CartesianProduct|BroadcastNestedLoopJoin",
    "single_partition": r"Exchange SinglePartition",
    "sort_aggregate": r"SortAggregate",
    "python": r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas",
    "global_limit": r"GlobalLimit",
}


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = build_session("local[8]", 8)
    for name in args.names or list(QUERIES):
        text = plan_text(QUERIES[name](spark, args.sf_dir))
        flags = [k for k, pat in FLAGS.items() if re.search(pat, text)]
        scans = len(re.findall(r"FileScan parquet", text))
        exchanges = len(re.findall(r"Exchange (hash|range|round)", text))
        print(f"{name:32s} scans={scans:2d} exchanges={exchanges:2d} {' '.join(flags)}")
    spark.stop()


if __name__ == "__main__":
    main()
