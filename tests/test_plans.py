"""Plan checks for every registered query: nothing that stops scaling out."""

import datetime as dt
import os
import re

import pytest

import __spark_entry__ as entry
from metricslake.operators import ingest
from metricslake.queries import QUERIES

SF = "/root/testdata/sf0.001"

# global aggregates (no grouping key) end in one partition by design: one partial row
# per task; column_profile's string min/max are such a global aggregate, and the budgets
# count the repository list
GLOBAL_AGGREGATES = {"sf_applicable", "column_profile", "column_profile_stored", "budgeted_work", "runs_without_jobs_stored"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(os.environ.get("QUICK") == "1", reason="QUICK=1 skips the plan sweep")
def test_plans_scale_out(spark):
    problems = []
    for name, fn in QUERIES.items():
        text = _plan(fn(spark, SF))
        if re.search(r"CartesianProduct|BroadcastNestedLoopJoin", text):
            problems.append((name, "cross join"))
        if re.search(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas", text):
            problems.append((name, "python"))
        if name not in GLOBAL_AGGREGATES:
            if "Exchange SinglePartition" in text:
                problems.append((name, "single partition"))
            if "SortAggregate" in text:
                problems.append((name, "sort aggregate"))
        # every scan reads a pruned column list
        for scan in re.findall(r"FileScan parquet \[([^\]]*)\]", text):
            if len(scan.split(",")) > 12:
                problems.append((name, "wide scan"))
    assert problems == []


def test_filters_reach_the_scan(spark):
    text = _plan(entry.queries()["geomean_report"](spark, SF))
    # the metric-name filter removes the constant branch and the timing filters are pushed
    assert "peak_memory" not in text
    assert re.search(r"PushedFilters: \[[^\]]*l_returnflag", text)


@pytest.mark.parametrize(
    "name, scans", [("top_n_downloads", 2), ("top_n_weekly_pivot", 2), ("top_n_cumulative_pivot", 2), ("version_baselines", 3)]
)
def test_tables_are_read_once(spark, name, scans):
    assert _plan(QUERIES[name](spark, SF)).count("FileScan") == scans


@pytest.mark.parametrize("name", ["completed_prefix", "contiguity_gate", "reference_id_cut"])
def test_runs_are_filtered_where_they_are_read(spark, name):
    """The runs meet the table of their repositories without an exchange, before any runtime re-planning."""
    text = _plan(QUERIES[name](spark, SF))
    assert "AdaptiveSparkPlan isFinalPlan=false" in text
    assert not re.search(r"hashpartitioning\([^)]*(_rid|repo_id|n_nationkey)", text)


def test_only_months_of_recent_runs_are_read(spark):
    text = _plan(QUERIES["runs_without_jobs_stored"](spark, SF))
    assert re.search(r"PartitionFilters: \[\(?isnull\(run_month.* OR \(run_month#\d+ >= ", text)


def test_extremes_come_from_statistics(spark):
    text = QUERIES["column_profile_stored"](spark, SF)._jdf.queryExecution().toString()
    assert re.search(r"PushedAggregation: \[MIN\(l_orderkey\), MAX\(l_orderkey\)", text)
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", text)
    assert scans and not any("l_orderkey" in s or "l_linenumber" in s for s in scans)


def test_a_large_side_is_not_broadcast(spark):
    """Beyond the threshold the table of repositories is shuffled: its size is known, not hoped for."""
    runs = spark.range(1000).selectExpr("id", "id % 7 as repo_id", "'completed' as status", "timestamp_ntz'2024-01-01' as updated_at")
    marks = spark.range(1000).selectExpr("id as repository_id", "cast(1 as long) as max_run_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        assert "SortMergeJoin" in _plan(ingest.completed_prefix(runs, marks, dt.datetime(2024, 6, 1)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_nothing_runs_while_a_plan_is_built(spark):
    names = ("query_times_report", "benchmark_query_times", "top_n_weekly_pivot", "budgeted_work", "upsert_changed")
    for name in names:
        QUERIES[name](spark, SF)  # the first use of a table reads its schema in a job
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "plans of registered queries")
    try:
        for name in names:
            QUERIES[name](spark, SF)
        assert list(tracker.getJobIdsForGroup("build")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
