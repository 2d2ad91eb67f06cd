"""Report semantics: flags, NULL order, tie-breaks, running sums and pivots."""

import datetime as dt

from pyspark.sql import functions as F

from metricslake.params import BenchmarkFilters, DownloadFilters
from metricslake.plans import benchmark_reports as br
from metricslake.plans import download_reports as dr
from metricslake.plans import views
from metricslake.schemas import EXTENSION_DOWNLOADS

T = dt.datetime(2024, 1, 1)
V = BenchmarkFilters().pinned_versions


def _qt(spark, rows):
    schema = (
        "run_id long, run_timestamp timestamp_ntz, storage_type string, engine_version string, "
        "benchmark_series string, query int, median_seconds double, timed_runs long, status string"
    )
    return spark.createDataFrame(rows, schema)


def _geo(spark, rows):
    schema = (
        "run_id long, run_timestamp timestamp_ntz, run_date string, storage_type string, "
        "benchmark string, scale_factor double, scale_factor_label string, "
        "benchmark_series string, machine_label string, cpu_arch_label string, "
        "engine_version string, geomean_seconds double"
    )
    return spark.createDataFrame(rows, schema)


def test_query_times_flags_and_order(spark):
    s = "tpch @ sf1"
    qt = _qt(
        spark,
        [
            # chosen run 10 (alpha): queries 1..5
            (10, T, "native", "v2", s, 1, 1.105, 5, "ok"),
            (10, T, "native", "v2", s, 2, 1.005, 5, "ok"),
            (10, T, "native", "v2", s, 3, 0.895, 5, "ok"),
            (10, T, "native", "v2", s, 4, 2.0, 5, "ok"),  # no baseline at all
            (10, T, "native", "v2", s, 5, None, 0, "failed"),
            # baselines: v1.5.5 medians of two runs, v1.4.5 only for query 1
            (1, T, "native", "v1.5.5", s, 1, 1.0, 5, "ok"),
            (2, T, "native", "v1.5.5", s, 1, 1.0, 5, "ok"),
            (1, T, "native", "v1.5.5", s, 2, 1.0, 5, "ok"),
            (1, T, "native", "v1.5.5", s, 3, 1.0, 5, "ok"),
            (3, T, "native", "v1.4.5", s, 1, 0.5, 5, "ok"),
            (4, T, "lake", "v1.5.5", s, 4, 1.0, 5, "ok"),  # other storage: ignored
        ],
    )
    geo = _geo(spark, [(10, T, "x", "native", "tpch", 1.0, "sf1", s, "m", "a", "v2", 1.0)])
    f = BenchmarkFilters(storage_type="native", run_id="10")
    rows = br.query_times_report(geo, qt, f).collect()
    assert [r.query for r in rows] == [1, 2, 3, 4, 5]
    r1, r2, r3, r4, r5 = rows
    assert (r1.primary_ratio, r1.primary_flag) == (1.11, 1)  # 1.105 -> 1.11 > 1.1
    assert (r1.secondary_ratio, r1.secondary_flag) == (2.21, 1)
    assert (r2.primary_ratio, r2.primary_flag) == (1.0, None)
    assert (r3.primary_ratio, r3.primary_flag) == (0.9, None)  # 0.895 -> 0.9, not < 0.9
    assert r4.primary_baseline_s is None and r4.primary_ratio is None  # blank, sorted last
    assert r5.median_s is None and r5.status == "failed"


def test_selected_run_defaults_to_newest(spark):
    geo = _geo(
        spark,
        [
            (1, T, "a", "native", "tpch", 1.0, "sf1", "s", "m", "a", "v", 1.0),
            (3, T + dt.timedelta(days=1), "b", "native", "tpch", 1.0, "sf1", "s", "m", "a", "v", 1.0),
            (2, T + dt.timedelta(days=1), "b", "native", "tpch", 1.0, "sf1", "s", "m", "a", "v", 1.0),
            (9, T + dt.timedelta(days=5), "c", "lake", "tpch", 1.0, "sf1", "s", "m", "a", "v", 1.0),
        ],
    )
    # equal newest timestamps resolve to the larger run id
    assert br.selected_run(geo, BenchmarkFilters()).first().run_id == 3


def test_sf_filter_exempts_null_scale_factor(spark):
    geo = _geo(
        spark,
        [
            (1, T, "a", "native", "tpch", 1.0, "sf1", "tpch @ sf1", "m", "a", "v", 1.0),
            (2, T, "a", "native", "tpch", 10.0, "sf10", "tpch @ sf10", "m", "a", "v", 1.0),
            (3, T, "a", "native", "clickbench", None, "n/a", "clickbench", "m", "a", "v", 1.0),
        ],
    ).withColumns({"engine_commit_sha": F.lit("0123456789"), "queries_sha": F.lit("abcdefghij"),
                   "queries_ok": F.lit(1), "queries_attempted": F.lit(1),
                   "queries_failed": F.lit(0), "is_complete": F.lit(True)})
    f = BenchmarkFilters(sf_labels=("sf1",))
    rows = br.geomean_report(geo, f).collect()
    assert sorted(r.benchmark_series for r in rows) == ["clickbench", "tpch @ sf1"]
    assert rows[0].commit == "01234567" and rows[0].query_set == "abcdefgh"


def test_version_baseline_is_latest_non_null(spark):
    t1, t2 = T, T + dt.timedelta(days=1)
    geo = _geo(
        spark,
        [
            (1, t1, "a", "native", "tpch", 1.0, "sf1", "s", "m", "a", "v1.5.5", 3.0),
            (2, t2, "a", "native", "tpch", 1.0, "sf1", "s", "m", "a", "v1.5.5", None),
            (3, t1, "a", "native", "tpch", 1.0, "sf1", "s", "m", "a", "v1.4.5", 5.0),
            (4, t1, "a", "native", "tpch", 1.0, "sf1", "s", "m", "a", "v1.4.5", 6.0),
        ],
    )
    got = {r.engine_version: r.baseline_seconds for r in br.version_baselines(geo, BenchmarkFilters()).collect()}
    assert got == {"v1.5.5": 3.0, "v1.4.5": 6.0}  # NULL skipped; tie on time -> larger run id


def _downloads(spark):
    rows = []
    for week in (1, 2, 3):
        rows += [
            (2024, week, "a", 10, T, "core"),
            (2024, week, "b", 10, T, "core"),  # ties with a: name decides
            (2024, week, "c", 1, T, "community"),
        ]
    rows.append((2024, 2, "a", 5, T, "community"))
    return spark.createDataFrame(rows, EXTENSION_DOWNLOADS)


def test_top_n_tie_break_and_running_sum(spark):
    d = _downloads(spark)
    f = DownloadFilters(from_year=2024, from_week=1, to_year=2024, to_week=3, top_n=1)
    assert [r.extension_name for r in dr.top_n_extensions(d, f).collect()] == ["a"]
    f2 = DownloadFilters(from_year=2024, from_week=1, to_year=2024, to_week=3, top_n=2)
    rows = dr.top_n_downloads(d, f2).collect()
    last = {r.extension: r.cumulative_downloads for r in rows if r.period == dt.date(2024, 1, 15)}
    totals = {r.extension: r.t for r in d.groupBy(F.col("extension_name").alias("extension"))
              .agg(F.sum("downloads").alias("t")).collect()}
    assert last == {"a": totals["a"], "b": totals["b"]}  # running sum at the last week = total
    f3 = DownloadFilters(from_year=2024, from_week=1, to_year=2024, to_week=3, repository="core", top_n=1)
    assert [r.extension_name for r in dr.top_n_extensions(d, f3).collect()] == ["a"]


def test_pivot_cells_equal_long_form(spark):
    d = _downloads(spark)
    f = DownloadFilters(from_year=2024, from_week=1, to_year=2024, to_week=3, top_n=3)
    piv = {r.extension: r.asDict() for r in dr.top_n_weekly_pivot(d, f).collect()}
    assert piv["a"]["2024-W02"] == 15 and piv["c"]["2024-W03"] == 1
    cum = {r.extension: r.asDict() for r in dr.top_n_cumulative_pivot(d, f).collect()}
    assert cum["a"]["2024-W03"] == 35 and cum["b"]["2024-W02"] == 20


def test_extension_detail_and_weeks(spark):
    d = _downloads(spark)
    f = DownloadFilters(from_year=2024, from_week=1, to_year=2024, to_week=3, extension="a")
    rows = dr.extension_detail(d, f).collect()
    assert [r.downloads for r in rows] == [10, 15, 10]
    assert [r.cumulative_downloads for r in rows] == [10, 25, 35]
    assert rows[0].period == dt.date(2024, 1, 1) and rows[1].period == dt.date(2024, 1, 8)
    assert [r.week for r in dr.weeks(spark).collect()] == list(range(1, 53))


def test_run_jobs_runner_label(spark):
    jobs = spark.createDataFrame(
        [
            (1, 10, "j1", "w", ["ubuntu", "x"], T, T, T + dt.timedelta(hours=1)),
            (2, 10, "j2", "w", [], T, T, T + dt.timedelta(hours=1)),
            (3, 10, "j3", "w", None, T, T, T + dt.timedelta(hours=1)),
            (4, 10, "j4", "w", [None], T, T, T + dt.timedelta(hours=1)),
            (5, 10, "j5", "w", ["a"], T, T, T),  # not completed after start
        ],
        "id long, run_id long, name string, workflow_name string, labels array<string>, "
        "created_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz",
    )
    runs = spark.createDataFrame(
        [(10, "push", {"id": 1, "full_name": "org/a"})],
        "id long, event string, repository struct<id:long,full_name:string>",
    )
    repos = spark.createDataFrame([(1, "org/a", False)], "id long, full_name string, private boolean")
    got = {r.job_name: r.runner for r in views.run_jobs(jobs, runs, repos).collect()}
    # empty and NULL lists -> '' (the size test is not true); a NULL first label stays NULL
    assert got == {"j1": "ubuntu", "j2": "", "j3": "", "j4": None}


def test_baselines_from_sketches(spark):
    """Within the bound of the exact median, the same whatever days are sketched apart, exact for few values."""
    rows = [(f"r{k}", dt.datetime(2024, 1, 1 + k % 9), "native", "tpch", q, v, float((k * 7919) % 10007) if v == V[0] else 1.0 + k)
            for q in ("q1", "q2") for v in V for k in range(10007 if v == V[0] else 5)]
    columns = "run_id string, run_timestamp timestamp_ntz, storage_type string, benchmark_series string, query string, engine_version string, median_seconds double"
    times = spark.createDataFrame(rows, columns).unionByName(spark.createDataFrame([("r", None, "native", "tpch", "q1", V[0], None)], columns))
    f = BenchmarkFilters(storage_type="native")
    sketches = br.baseline_sketches(times)
    found = {(r.query, r.engine_version): r.baseline_seconds for r in br.merged_baselines(sketches, f).collect()}
    exact = {(r.query, r.engine_version): r.baseline_seconds for r in br.baseline_medians(times, f).collect()}
    assert found.keys() == exact.keys()
    for key, value in found.items():
        # values are 0..10006, so a distance is one in rank
        assert abs(value - exact[key]) <= (br.SKETCH_ERROR * 10007 if key[1] == V[0] else 0)
    assert br.merged_baselines(sketches.where("false"), f).collect() == []
