"""Hand-made cases for the derived benchmark tables (NULL, failed, floor, labels)."""

import datetime as dt
import math

from metricslake.operators import derived
from metricslake.schemas import QUERY_METRICS, QUERY_RESULTS, RUNS

T0 = dt.datetime(2024, 5, 1, 10, 30)


def _run(run_id, is_test=False, sf=1.0, cpu="x86_64", machine=None, ts=T0, benchmark="tpch"):
    return (run_id, 1, ts, is_test, benchmark, "native", sf, "v1.5.5", "abc", "release", "linux",
            cpu, machine, 8, "16GB", "native", 5, "sha")


def _frames(spark):
    runs = spark.createDataFrame(
        [
            _run(1, sf=100.0),
            _run(2, is_test=None, sf=None, cpu=None, benchmark="clickbench"),
            _run(3, is_test=True),
            _run(4),  # all queries failed
            _run(5, sf=0.5),  # one failed query
        ],
        RUNS,
    )
    qr = spark.createDataFrame(
        [
            (1, 1, "ok", True, None), (1, 2, "ok", True, None),
            (2, 1, "ok", True, None),
            (3, 1, "ok", True, None),
            (4, 1, "failed", False, "boom"), (4, 2, "failed", False, "boom"),
            (5, 1, "ok", True, None), (5, 2, "failed", False, "boom"),
        ],
        QUERY_RESULTS,
    )
    m = "execution_time_seconds"
    qm = spark.createDataFrame(
        [
            (1, 1, m, 1.0), (1, 1, m, 3.0), (1, 2, m, 4.0),
            (1, 2, m, None), (1, 2, m, 0.0), (1, 2, m, -1.0),  # not measurements
            (1, 1, "peak_memory", 99.0),
            (2, 1, m, 1e-9),  # below the floor
            (3, 1, m, 5.0),
            (4, 1, m, 2.0),  # timing of a failed query
            (5, 1, m, 2.0), (5, 2, m, 8.0),
        ],
        QUERY_METRICS,
    )
    return runs, qr, qm


def test_geomean_rows_and_values(spark):
    runs, qr, qm = _frames(spark)
    rows = {int(r.run_id): r for r in derived.benchmark_geomean(runs, qr, qm).collect()}
    # test run 3 excluded; run 4 has no ok timing -> absent
    assert set(rows) == {1, 2, 5}
    r1 = rows[1]
    assert math.isclose(r1.geomean_seconds, math.sqrt(2.0 * 4.0))
    assert (r1.queries_ok, r1.queries_attempted, r1.queries_failed, r1.is_complete) == (2, 2, 0, True)
    assert (r1.fastest_query_seconds, r1.slowest_query_seconds) == (2.0, 4.0)
    assert r1.scale_factor_label == "sf100" and r1.benchmark_series == "tpch @ sf100"
    assert r1.run_date == "2024-05-01 10:30"
    assert r1.machine_label == "unspecified" and r1.cpu_arch_label == "x86_64"
    r2 = rows[2]  # NULL is_test counts as not a test; NULL sf and cpu get labels
    assert r2.scale_factor_label == "n/a" and r2.benchmark_series == "clickbench"
    assert r2.cpu_arch_label == "unknown"
    assert math.isclose(r2.geomean_seconds, 1e-6)  # floor applied to the geomean input
    assert r2.fastest_query_seconds == 1e-9  # min/max see the raw mean
    r5 = rows[5]
    assert (r5.queries_ok, r5.queries_failed, r5.is_complete) == (1, 1, False)
    assert r5.geomean_seconds == 2.0  # the failed query's timing is not used
    assert r5.scale_factor_label == "sf0.5"


def test_query_times_keeps_failed_queries(spark):
    runs, qr, qm = _frames(spark)
    rows = {(int(r.run_id), r.query): r for r in derived.benchmark_query_times(runs, qr, qm).collect()}
    assert (3, 1) not in rows  # test run
    assert (4, 2) in rows and rows[(4, 2)].median_seconds is None
    # no status filter on the timing side: a failed query keeps its timing
    assert rows[(4, 1)].mean_seconds == 2.0 and rows[(4, 1)].status == "failed"
    assert rows[(5, 2)].timed_runs == 1
    r = rows[(1, 1)]
    assert (r.mean_seconds, r.median_seconds, r.fastest_seconds, r.slowest_seconds, r.timed_runs) == (
        2.0, 2.0, 1.0, 3.0, 2,
    )
    assert rows[(1, 2)].timed_runs == 1  # NULL, 0 and negative are not measurements


def test_warm_run_mean_excludes_failed_and_test(spark):
    runs, qr, qm = _frames(spark)
    got = {(int(r.run_id), r.query): r.seconds for r in derived.warm_run_mean(runs, qr, qm).collect()}
    assert got == {(1, 1): 2.0, (1, 2): 4.0, (2, 1): 1e-9, (5, 1): 2.0}


def test_run_aggregates_need_no_join(spark):
    """Results and timings meet in one aggregate: no side is sorted, odd rows count as in a join."""
    m = "execution_time_seconds"
    qr = spark.createDataFrame(
        [
            ("a", 1, "ok", True, None), ("a", 1, "failed", True, None), ("a", 1, "ok", True, None),  # one key, thrice
            ("a", 2, None, True, None),  # neither ok nor failed
            ("a", None, "ok", True, None), (None, 1, "ok", True, None),  # meet no timing
            ("b", 1, "failed", True, None),
        ],
        QUERY_RESULTS,
    )
    qm = spark.createDataFrame(
        [
            ("a", 1, m, 2.0), ("a", 1, m, 6.0), ("a", 2, m, 9.0), ("a", None, m, 9.0), (None, 1, m, 9.0),
            ("a", 3, m, 9.0), ("b", 1, m, 9.0), ("c", 1, m, 9.0),  # no result, or a failed one
        ],
        QUERY_METRICS,
    )
    got = derived.run_aggregates(qr, qm)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {r.run_id: r for r in got.collect()}
    assert set(rows) == {"a", "b", None}
    a = rows["a"]
    assert math.isclose(a.geomean_seconds, 4.0)
    assert (a.queries_ok, a.fastest_query_seconds, a.slowest_query_seconds) == (1, 4.0, 4.0)
    assert (a.queries_attempted, a.queries_failed) == (5, 1)
    for other, attempted, failed in (("b", 1, 1), (None, 1, 0)):
        r = rows[other]
        assert (r.geomean_seconds, r.queries_ok, r.queries_attempted, r.queries_failed) == (None, 0, attempted, failed)
