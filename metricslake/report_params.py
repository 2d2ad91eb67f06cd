"""Fixed page parameters used by the registered report queries and their oracles.

Chosen so every filter removes something on the test tables (order dates run
1995-2001, ship dates 1995-2001, 25 repositories of which 5 are private).
"""

from __future__ import annotations

import datetime as dt

from metricslake.params import BenchmarkFilters, CIFilters, DownloadFilters

BENCH_NATIVE = BenchmarkFilters(
    storage_type="native",
    benchmarks=("tpch", "tpcds", "clickbench"),
    sf_labels=("sf1", "sf100"),
    machines=("m1", "unspecified"),
    cpu_archs=("arm64", "x86_64", "unknown"),
    start=dt.datetime(1996, 1, 1),
    end=dt.datetime(1999, 12, 31),
)

BENCH_LAKE = BenchmarkFilters(
    storage_type="lake",
    benchmarks=("tpch", "clickbench"),
    sf_labels=("sf10",),
    machines=("m1",),
    cpu_archs=("x86_64", "unknown"),
    start=dt.datetime(1997, 1, 1),
    end=dt.datetime(2000, 6, 30),
)

CI_FILTERS = CIFilters(
    runners=("", "os-1", "os-3"),
    repos=tuple(f"org/nation_{i}" for i in (1, 2, 3, 7, 11, 12, 13, 14, 24)),
    start=dt.datetime(1996, 1, 1),
    end=dt.datetime(1999, 6, 30),
)

DOWNLOADS_ALL = DownloadFilters(
    from_year=1996, from_week=1, to_year=1997, to_week=26, repository="%", top_n=5,
    extension="Brand#13",
)

DOWNLOADS_CORE = DownloadFilters(
    from_year=1998, from_week=10, to_year=1999, to_week=52, repository="core", top_n=10,
    extension="Brand#7",
)
