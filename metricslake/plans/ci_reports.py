"""CI report queries over ``all_runs`` / ``run_jobs`` / ``wait_times``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricslake import fixed as fx
from metricslake.functions import epoch_seconds, round_half_away, to_ntz
from metricslake.params import CIFilters

JOB_NAME_WIDTH = fx.JOB_NAME_WIDTH


def daily_runs(all_runs: DataFrame) -> DataFrame:
    """Runs per creation day (the day as a naive timestamp)."""
    day = to_ntz(F.date_trunc("day", F.col("created_at")))
    return (
        all_runs.groupBy(day.alias("date"))
        .agg(F.count(F.lit(1)).alias("nr_runs"))
        .orderBy(F.col("date").asc_nulls_last())
    )


def wait_time(wait_times: DataFrame) -> DataFrame:
    """The wait-time chart: every row of ``wait_times``."""
    return wait_times


def runner_options(run_jobs: DataFrame) -> DataFrame:
    return run_jobs.select("runner").distinct()


def repo_options(run_jobs: DataFrame) -> DataFrame:
    return run_jobs.select("repo").distinct()


def _selected(run_jobs: DataFrame, f: CIFilters) -> DataFrame:
    cond: Column = F.col("completed_at") > F.col("started_at")
    if f.runners is not None:
        cond &= F.col("runner").isin(list(f.runners))
    if f.repos is not None:
        cond &= F.col("repo").isin(list(f.repos))
    if f.start is not None:
        cond &= F.col("started_at") >= F.lit(f.start).cast("timestamp_ntz")
    if f.end is not None:
        cond &= F.col("started_at") <= F.lit(f.end).cast("timestamp_ntz")
    return run_jobs.where(cond)


# report name -> (grouping column, output name of the group column)
RUNTIME_KEYS = {
    "runner": ("runner", "runner"),
    "repository": ("repo", "repository"),
    "event": ("event", "event"),
    "workflow": ("workflow_name", "workflow_name"),
    "job": ("job_name", "job_name"),
}


def runtime_by(run_jobs: DataFrame, by: str, f: CIFilters) -> DataFrame:
    """Jobs, total runtime in minutes (rounded to 0) and average = rounded total / jobs.

    The job report groups by the full job name and shows it cut to 60 characters,
    so two long names with one prefix stay two rows.
    """
    key, out_name = RUNTIME_KEYS[by]
    g = _selected(run_jobs, f).groupBy(key).agg(
        F.count(F.lit(1)).alias("jobs"),
        round_half_away(
            F.sum(epoch_seconds(F.col("started_at"), F.col("completed_at"))) / F.lit(60.0), 0
        ).alias("total_minutes"),
    )
    g = g.withColumn("avg_runtime", round_half_away(F.col("total_minutes") / F.col("jobs"), 2))
    shown = F.substring(key, 1, JOB_NAME_WIDTH) if by == "job" else F.col(key)
    return g.orderBy(F.col(key).asc_nulls_last()).select(
        shown.alias(out_name), "jobs", "total_minutes", "avg_runtime"
    )
