"""Registry of runnable queries over the given tables, with their DuckDB oracles.

Every entry takes ``(spark, sf_dir)``, builds the model tables from the test
tables with ``metricslake.sources.adapters`` and applies one operator, so its
work grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricslake import ingest_queries, lake_queries, oracle_derived, oracle_reports
from metricslake.operators import derived
from metricslake.plans import benchmark_reports as br
from metricslake.plans import ci_reports as cr
from metricslake.plans import download_reports as dr
from metricslake.plans import views
from metricslake.report_params import (
    BENCH_LAKE,
    BENCH_NATIVE,
    CI_FILTERS,
    DOWNLOADS_ALL,
    DOWNLOADS_CORE,
)
from metricslake.session import configure
from metricslake.sources.adapters import model_table

Query = Callable[[SparkSession, str], DataFrame]


def _bench(spark: SparkSession, sf_dir: str):
    configure(spark)
    return (
        model_table(spark, sf_dir, "runs"),
        model_table(spark, sf_dir, "query_results"),
        model_table(spark, sf_dir, "query_metrics"),
    )


def q_warm_run_mean(spark, sf_dir):
    return derived.warm_run_mean(*_bench(spark, sf_dir))


def q_run_geomean(spark, sf_dir):
    runs, qr, qm = _bench(spark, sf_dir)
    return derived.run_geomean(derived.warm_run_mean(runs, qr, qm))


def q_run_attempts(spark, sf_dir):
    _, qr, _ = _bench(spark, sf_dir)
    return derived.run_attempts(qr)


def q_benchmark_geomean(spark, sf_dir):
    return derived.benchmark_geomean(*_bench(spark, sf_dir))


def q_warm_run_stats(spark, sf_dir):
    _, _, qm = _bench(spark, sf_dir)
    return derived.warm_run_stats(qm)


def q_benchmark_query_times(spark, sf_dir):
    return derived.benchmark_query_times(*_bench(spark, sf_dir))


def _geomean(spark, sf_dir):
    return derived.benchmark_geomean(*_bench(spark, sf_dir), ordered=False)


def _query_times(spark, sf_dir):
    return derived.benchmark_query_times(*_bench(spark, sf_dir), ordered=False)


def _on_geomean(fn):
    return lambda spark, sf_dir: fn(_geomean(spark, sf_dir))


def _ci(spark, sf_dir):
    configure(spark)
    jobs = model_table(spark, sf_dir, "ci_jobs")
    runs = model_table(spark, sf_dir, "ci_runs")
    repos = model_table(spark, sf_dir, "ci_repositories")
    return jobs, runs, repos


def _run_jobs(spark, sf_dir):
    return views.run_jobs(*_ci(spark, sf_dir))


def _downloads(spark, sf_dir):
    configure(spark)
    return model_table(spark, sf_dir, "extension_downloads")


def q_all_runs(spark, sf_dir):
    _, runs, _ = _ci(spark, sf_dir)
    # the repository struct flattened for comparison with flat SQL
    return views.passthrough(runs).select(
        "id", "status", "event", "html_url", "created_at", "updated_at",
        F.col("repository.id").alias("repo_id"), F.col("repository.full_name").alias("repo"),
    )


def _query_times_report(f):
    def run(spark, sf_dir):
        runs, qr, qm = _bench(spark, sf_dir)
        # the report needs few runs: one of those to choose from, and the pinned releases' for the baselines
        options = br.matching_runs(runs, f)
        pinned = runs.where((F.col("storage_type") == f.storage_type) & F.col("engine_version").isin(list(f.pinned_versions)))
        geomean = derived.benchmark_geomean(options, *derived.of_runs(options, qr, qm), ordered=False)
        times = derived.benchmark_query_times(runs, qr, qm, ordered=False)
        baselines = derived.benchmark_query_times(pinned, *derived.of_runs(pinned, qr, qm), ordered=False)
        return br.query_times_report(geomean, times, f, baselines)

    return run


def _runtime(by):
    return lambda spark, sf_dir: cr.runtime_by(_run_jobs(spark, sf_dir), by, CI_FILTERS)


def _download_queries(f, suffix):
    def d(fn):
        return lambda spark, sf_dir: fn(_downloads(spark, sf_dir), f)

    return {
        f"top_n_extensions{suffix}": d(dr.top_n_extensions),
        f"top_n_downloads{suffix}": d(dr.top_n_downloads),
        f"extension_detail{suffix}": d(dr.extension_detail),
        f"top_n_weekly_pivot{suffix}": d(dr.top_n_weekly_pivot),
        f"top_n_cumulative_pivot{suffix}": d(dr.top_n_cumulative_pivot),
        f"raw_downloads{suffix}": d(dr.raw_downloads),
    }


QUERIES: dict[str, Query] = {
    # derived tables (flagship first)
    "benchmark_geomean": q_benchmark_geomean,
    "warm_run_mean": q_warm_run_mean,
    "run_geomean": q_run_geomean,
    "run_attempts": q_run_attempts,
    "warm_run_stats": q_warm_run_stats,
    "benchmark_query_times": q_benchmark_query_times,
    # source views
    "benchmark_list": _on_geomean(views.benchmark_list),
    "benchmark_series_list": _on_geomean(views.benchmark_series_list),
    "cpu_arch_list": _on_geomean(views.cpu_arch_list),
    "machine_list": _on_geomean(views.machine_list),
    "scale_factor_list": _on_geomean(views.scale_factor_list),
    "storage_type_list": _on_geomean(views.storage_type_list),
    "geomean_runs": _on_geomean(views.passthrough),
    "query_times_all": lambda spark, sf_dir: views.passthrough(_query_times(spark, sf_dir)),
    "all_runs": q_all_runs,
    "run_jobs": _run_jobs,
    "wait_times": lambda spark, sf_dir: views.wait_times(_ci(spark, sf_dir)[0]),
    "extension_downloads_all": lambda spark, sf_dir: views.passthrough(_downloads(spark, sf_dir)),
    # benchmark reports
    "benchmark_options": _on_geomean(br.benchmark_options),
    "sf_options": _on_geomean(br.sf_options),
    "machine_options": _on_geomean(br.machine_options),
    "cpu_arch_options": _on_geomean(br.cpu_arch_options),
    "sf_applicable": _on_geomean(lambda g: br.sf_applicable(g, BENCH_NATIVE)),
    "geomean_report": _on_geomean(lambda g: br.geomean_report(g, BENCH_NATIVE)),
    "geomean_report_lake": _on_geomean(lambda g: br.geomean_report(g, BENCH_LAKE)),
    "version_baselines": _on_geomean(lambda g: br.version_baselines(g, BENCH_NATIVE)),
    "chart_bounds": _on_geomean(
        lambda g: br.chart_bounds(
            br.geomean_report(g, BENCH_NATIVE, ordered=False), br.version_baselines(g, BENCH_NATIVE)
        )
    ),
    "series_shown": _on_geomean(
        lambda g: br.series_shown(br.geomean_report(g, BENCH_NATIVE, ordered=False))
    ),
    "run_table": _on_geomean(lambda g: br.run_table(br.geomean_report(g, BENCH_NATIVE, ordered=False))),
    "run_options": _on_geomean(lambda g: br.run_options(g, BENCH_NATIVE)),
    "query_times_report": _query_times_report(BENCH_NATIVE),
    "query_times_report_lake": _query_times_report(BENCH_LAKE),
    "run_counts": lambda spark, sf_dir: br.run_counts(_bench(spark, sf_dir)[0]),
    # CI reports
    "daily_runs": lambda spark, sf_dir: cr.daily_runs(_ci(spark, sf_dir)[1]),
    "wait_time": lambda spark, sf_dir: cr.wait_time(views.wait_times(_ci(spark, sf_dir)[0])),
    "runner_options": lambda spark, sf_dir: cr.runner_options(_run_jobs(spark, sf_dir)),
    "repo_options": lambda spark, sf_dir: cr.repo_options(_run_jobs(spark, sf_dir)),
    "runtime_by_runner": _runtime("runner"),
    "runtime_by_repository": _runtime("repository"),
    "runtime_by_event": _runtime("event"),
    "runtime_by_workflow": _runtime("workflow"),
    "runtime_by_job": _runtime("job"),
    # extension download reports
    "extensions": lambda spark, sf_dir: dr.extensions(_downloads(spark, sf_dir)),
    **_download_queries(DOWNLOADS_ALL, ""),
    **_download_queries(DOWNLOADS_CORE, "_core"),
    # ingestion operators (relational core)
    **ingest_queries.QUERIES,
    # tables written and read back
    **lake_queries.QUERIES,
}

ORACLES: dict[str, str] = {
    **oracle_derived.ORACLES,
    **oracle_reports.ORACLES,
    **ingest_queries.ORACLES,
    **lake_queries.ORACLES,
}
