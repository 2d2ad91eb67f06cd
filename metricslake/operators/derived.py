"""Benchmark derived tables: per-query warm-run aggregates and per-run geomeans.

Two aggregation levels, as in the source model:

1. per (run, query): the warm runs of a query -> mean (and median/min/max/count);
2. per run: the geometric mean over the queries of the run.

Plan shape (what ``explain`` shows): the timing filter and the column pruning reach
the ``query_metrics`` scan; level 1 is a partial + final hash aggregate, so only
one partial row per (run, query) and map task crosses the shuffle. In
``benchmark_geomean`` results and timings are one union, reduced to one row per
(run, query) without a join; one aggregate on ``run_id`` (``run_aggregates``) then
gives the geomean and the attempt counts from a single read of ``query_results``,
and the join with ``runs`` moves ``runs`` only.
The standalone ``warm_run_mean`` / ``run_geomean`` / ``run_attempts`` are the same
steps one at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricslake import fixed as fx
from metricslake.functions import fmt_g
from metricslake.functions.median import median_of_counts, value_counts

EXEC_METRIC = fx.EXEC_METRIC
GEOMEAN_FLOOR = fx.GEOMEAN_FLOOR  # a sub-microsecond timing is the measurement floor


def non_test_runs(runs: DataFrame) -> DataFrame:
    """Runs that are not tests; a NULL ``is_test`` counts as not a test."""
    return runs.where(~F.coalesce(F.col("is_test"), F.lit(False)))


def of_runs(runs: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The rows of result tables that belong to ``runs`` which are no tests: filtered before anything
    is aggregated, where the table of run ids is small enough to be broadcast without moving them."""
    ids = non_test_runs(runs).select("run_id")
    return [t.join(ids, "run_id", "left_semi") for t in tables]


def valid_timings(query_metrics: DataFrame) -> DataFrame:
    """Execution-time rows that are measurements: not NULL and above zero."""
    return query_metrics.where(
        (F.col("metric_name") == EXEC_METRIC)
        & F.col("metric_value").isNotNull()
        & (F.col("metric_value") > 0)
    ).select("run_id", "query", "metric_value")


def _per_query_mean(query_results: DataFrame, query_metrics: DataFrame) -> DataFrame:
    # Aggregate first, then keep the (run, query) keys whose result is 'ok'. Equal to
    # joining first: every timing row of a key meets the same result rows, so the
    # mean is unchanged, and the shuffle carries partial aggregates instead of rows.
    means = valid_timings(query_metrics).groupBy("run_id", "query").agg(
        F.avg("metric_value").alias("seconds")
    )
    ok = query_results.where(F.col("status") == "ok").select("run_id", "query")
    return means.join(ok, ["run_id", "query"], "left_semi")


def warm_run_mean(runs: DataFrame, query_results: DataFrame, query_metrics: DataFrame) -> DataFrame:
    """(run_id, query, seconds): mean warm-run time of ok queries of non-test runs."""
    per_query = _per_query_mean(query_results, query_metrics)
    return per_query.join(non_test_runs(runs).select("run_id"), "run_id", "left_semi")


def run_geomean(per_query: DataFrame) -> DataFrame:
    """Per run: geomean of greatest(seconds, 1e-6), count, fastest and slowest query."""
    return per_query.groupBy("run_id").agg(
        F.exp(F.avg(F.log(F.greatest(F.col("seconds"), F.lit(GEOMEAN_FLOOR))))).alias(
            "geomean_seconds"
        ),
        F.count(F.lit(1)).alias("queries_ok"),
        F.min("seconds").alias("fastest_query_seconds"),
        F.max("seconds").alias("slowest_query_seconds"),
    )


def run_attempts(query_results: DataFrame) -> DataFrame:
    """Per run: queries attempted and failed (status other than 'ok')."""
    return query_results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("queries_attempted"),
        F.count_if(F.col("status") != "ok").alias("queries_failed"),
    )


def run_labels(runs: DataFrame) -> DataFrame:
    """Display labels added to runs; every label is NULL-safe for IN filters."""
    sf = fmt_g(F.col("scale_factor"))
    return runs.withColumns(
        {
            "run_date": F.date_format(F.col("run_ts"), fx.RUN_DATE_FORMAT),
            "scale_factor_label": F.coalesce(F.concat(F.lit(fx.SF_LABEL_PREFIX), sf), F.lit(fx.NO_SF_LABEL)),
            "benchmark_series": F.concat(
                F.col("benchmark"), F.coalesce(F.concat(F.lit(fx.SERIES_SF_SEPARATOR), sf), F.lit(""))
            ),
            "cpu_arch_label": F.coalesce(F.col("cpu_arch"), F.lit(fx.NO_CPU_ARCH_LABEL)),
            "machine_label": F.coalesce(F.col("machine_type"), F.lit(fx.NO_MACHINE_LABEL)),
        }
    )


GEOMEAN_COLUMNS = [
    "run_id", "invocation_id", "run_timestamp", "run_date", "benchmark", "benchmark_name",
    "scale_factor", "scale_factor_label", "benchmark_series", "engine_version",
    "engine_commit_sha", "binary_source", "os", "cpu_arch", "cpu_arch_label", "machine_type",
    "machine_label", "threads", "memory_limit", "storage_type", "warm_runs", "queries_sha",
    "geomean_seconds", "fastest_query_seconds", "slowest_query_seconds", "queries_ok",
    "queries_attempted", "queries_failed", "is_complete",
]


def run_aggregates(query_results: DataFrame, query_metrics: DataFrame) -> DataFrame:
    """run_geomean and run_attempts of every run from one pass over ``query_results``.

    Results and valid timings meet in one aggregate to a row per (run, query): a task holds one
    table of keys, and sorts neither side for a join. One aggregate on ``run_id`` then yields the
    geomean part (ok queries with a valid timing) and the attempt counts (every result row,
    duplicates included, as a count over the raw rows would). A key that has timings alone
    counts for nothing, and a NULL in the key matches no timing, as in a join.
    """
    status = F.col("status")
    results = query_results.select(
        "run_id", "query", F.lit(1).alias("_row"), (status != "ok").alias("_failed"), (status == "ok").alias("_ok"),
        F.lit(None).cast("double").alias("metric_value"),
    )
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("_row", "int"), ("_failed", "boolean"), ("_ok", "boolean"))]
    timings = valid_timings(query_metrics).select("run_id", "query", *none, "metric_value")
    both = results.unionByName(timings).groupBy("run_id", "query").agg(
        F.count("_row").alias("_rows"),
        F.count_if(F.col("_failed")).alias("_failed"),
        F.bool_or("_ok").alias("_ok"),
        F.avg("metric_value").alias("seconds"),
    )
    keyed = F.col("run_id").isNotNull() & F.col("query").isNotNull()
    ok = F.col("_ok") & keyed & F.col("seconds").isNotNull()
    ok_s = F.when(ok, F.col("seconds"))
    # greatest() skips NULLs, so the floor is applied inside the ok branch only
    ok_log = F.when(ok, F.log(F.greatest(F.col("seconds"), F.lit(GEOMEAN_FLOOR))))
    return both.where(F.col("_rows") > 0).groupBy("run_id").agg(
        F.exp(F.avg(ok_log)).alias("geomean_seconds"),
        F.count(ok_s).alias("queries_ok"),
        F.min(ok_s).alias("fastest_query_seconds"),
        F.max(ok_s).alias("slowest_query_seconds"),
        F.sum("_rows").alias("queries_attempted"),
        F.sum("_failed").alias("queries_failed"),
    )


def benchmark_geomean(
    runs: DataFrame, query_results: DataFrame, query_metrics: DataFrame, ordered: bool = True
) -> DataFrame:
    """One row per non-test run with a valid timing: geomean, counts and labels.

    A run without any valid timing is absent (``queries_ok > 0`` replaces the inner
    join with the per-run geomean). The test-run filter is applied once, at the
    final join with ``runs``: the aggregates of a test run are never joined.
    ``ordered`` sorts by (timestamp, benchmark, benchmark_name) as the stored table
    is; the sort is range-partitioned, and writing it sorted gives tight parquet
    min/max statistics on the timestamp for date-filtered reports.
    """
    per_run = run_aggregates(query_results, query_metrics).where(F.col("queries_ok") > 0)
    r = run_labels(non_test_runs(runs)).withColumnRenamed("run_ts", "run_timestamp")
    out = (
        r.join(per_run, "run_id")
        .withColumn("is_complete", F.col("queries_failed") == 0)
        .select(*GEOMEAN_COLUMNS)
    )
    if ordered:
        out = out.orderBy(
            F.col("run_timestamp").asc_nulls_last(),
            F.col("benchmark").asc_nulls_last(),
            F.col("benchmark_name").asc_nulls_last(),
        )
    return out


def warm_run_stats(query_metrics: DataFrame) -> DataFrame:
    """Per (run, query): mean, exact median, fastest, slowest and count of valid timings.

    No status filter here: a timing of a failed query still counts, as in the
    source model. All five come from one aggregate to (run, query, value, count), so a
    key with very many rows crosses the shuffle as its distinct values.
    """
    keys = ["run_id", "query"]
    counted = value_counts(valid_timings(query_metrics), keys, "metric_value")
    stats = counted.groupBy(*keys).agg(
        (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean_seconds"),
        F.min("_v").alias("fastest_seconds"),
        F.max("_v").alias("slowest_seconds"),
        F.sum("_c").alias("timed_runs"),
    )
    return stats.join(median_of_counts(counted, keys, "median_seconds"), keys)


QUERY_TIMES_COLUMNS = [
    "run_id", "run_timestamp", "run_date", "benchmark", "benchmark_name", "storage_type",
    "scale_factor", "scale_factor_label", "benchmark_series", "cpu_arch_label", "machine_label",
    "engine_version", "engine_commit_sha", "queries_sha", "query", "status", "verified", "error",
    "median_seconds", "mean_seconds", "fastest_seconds", "slowest_seconds", "timed_runs",
]


def benchmark_query_times(
    runs: DataFrame,
    query_results: DataFrame,
    query_metrics: DataFrame,
    ordered: bool = True,
) -> DataFrame:
    """One row per (non-test run, query result); failed queries kept with NULL timings."""
    r = run_labels(non_test_runs(runs)).withColumnRenamed("run_ts", "run_timestamp")
    qr = query_results.select("run_id", "query", "status", "verified", "error")
    # results and timing stats are both partitioned on (run_id, query): joined first,
    # they need no exchange; only their join result moves to meet ``runs``
    per_query = qr.join(warm_run_stats(query_metrics), ["run_id", "query"], "left")
    out = per_query.join(r, "run_id").select(*QUERY_TIMES_COLUMNS)
    if ordered:
        out = out.orderBy(
            F.col("run_timestamp").asc_nulls_last(),
            F.col("benchmark").asc_nulls_last(),
            F.col("query").asc_nulls_last(),
        )
    return out
