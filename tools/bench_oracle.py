"""Time the DuckDB oracle SQL of the bench's headline queries (the reference's own
engine running its SQL on the adapter views), same protocol as bench.py: one warm-up,
median of three. Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python tools/bench_oracle.py
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from bench import HEADLINE, REPEATS  # noqa: E402
from metricslake.queries import ORACLES  # noqa: E402
from metricslake.sources.tables import TEST_TABLES, table_path  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    con = duckdb.connect()
    con.execute(f"set threads = {cpus}")
    for t in TEST_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{table_path(sf_dir, t)}')")
    results = {}
    for name in sys.argv[1:] or HEADLINE:
        sql = ORACLES[name]

        def once() -> float:
            t0 = time.perf_counter()
            con.sql(sql).fetchall()
            return time.perf_counter() - t0

        once()
        results[name] = round(statistics.median(once() for _ in range(REPEATS)), 4)
    print(json.dumps({"engine": "duckdb", "value": round(sum(results.values()), 4), "queries": results,
                      "sf_dir": sf_dir, "threads": cpus}))


if __name__ == "__main__":
    main()
