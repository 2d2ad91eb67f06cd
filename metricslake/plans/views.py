"""Source views over the stored tables: filter-value lists, passthroughs, CI views.

Distinct lists run as partial + final hash aggregates on one low-cardinality
column, so only a handful of rows per task cross the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricslake.functions import epoch_seconds, half_even_int


def _distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(F.col(col).asc_nulls_last())


def benchmark_list(geomean: DataFrame) -> DataFrame:
    return _distinct_sorted(geomean, "benchmark")


def benchmark_series_list(geomean: DataFrame) -> DataFrame:
    return (
        geomean.select("benchmark_series", "benchmark", "scale_factor")
        .distinct()
        .orderBy(F.col("benchmark").asc_nulls_last(), F.col("scale_factor").asc_nulls_last())
    )


def cpu_arch_list(geomean: DataFrame) -> DataFrame:
    return _distinct_sorted(geomean, "cpu_arch_label")


def machine_list(geomean: DataFrame) -> DataFrame:
    return _distinct_sorted(geomean, "machine_label")


def scale_factor_list(geomean: DataFrame) -> DataFrame:
    """Real scale factors only, in lexical label order ('sf1', 'sf10', 'sf100')."""
    return _distinct_sorted(geomean.where(F.col("scale_factor").isNotNull()), "scale_factor_label")


def storage_type_list(geomean: DataFrame) -> DataFrame:
    return _distinct_sorted(geomean, "storage_type")


def passthrough(table: DataFrame) -> DataFrame:
    """``geomean_runs``, ``query_times_all``, ``all_runs``, ``extension_downloads_all``."""
    return table


def run_jobs(jobs: DataFrame, runs: DataFrame, repos: DataFrame) -> DataFrame:
    """Jobs of public repositories with their run's event and the runner label.

    runner = first label, or '' when the job has no label. The repository join is on
    the run's ``repository.full_name``; the repository list is a small dimension
    (planner broadcasts it when its size is under the threshold).
    """
    j = jobs.where(F.col("completed_at") > F.col("started_at")).select(
        F.col("run_id"),
        F.col("name").alias("job_name"),
        F.when(F.size("labels") > 0, F.get(F.col("labels"), 0)).otherwise(F.lit("")).alias("runner"),
        "completed_at",
        "started_at",
        "workflow_name",
    )
    r = runs.select(F.col("id").alias("run_id"), "event", F.col("repository.full_name").alias("repo"))
    p = repos.where(~F.col("private")).select(F.col("full_name").alias("repo"))
    return (
        j.join(r, "run_id")
        .join(p, "repo")
        .select("repo", "event", "job_name", "runner", "completed_at", "started_at", "workflow_name")
    )


def wait_times(jobs: DataFrame) -> DataFrame:
    """Per creation date: mean seconds from creation to start, rounded half to even."""
    return (
        jobs.where(F.col("started_at") >= F.col("created_at"))
        .groupBy(F.to_date("created_at").alias("date"))
        .agg(half_even_int(F.avg(epoch_seconds(F.col("created_at"), F.col("started_at")))).alias("wait_time"))
        .orderBy(F.col("date").asc_nulls_last())
    )
