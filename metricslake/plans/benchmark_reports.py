"""Benchmark report queries, one function per report, parameterized by storage type.

Inputs are the derived tables (``benchmark_geomean`` and ``benchmark_query_times``);
outputs are small (one row per shown run, series or query). Filters are literal
predicates, so on stored (parquet) derived tables they are pushed into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricslake import fixed as fx
from metricslake.functions import exact_median, round_half_away
from metricslake.operators import derived
from metricslake.params import BenchmarkFilters
from metricslake.plans import views

RATIO_HIGH = fx.RATIO_HIGH  # slower than the baseline beyond this ratio
RATIO_LOW = fx.RATIO_LOW  # faster than the baseline below this ratio
HEADROOM = fx.CHART_HEADROOM


def _in(col: str, values) -> Column:
    return F.lit(True) if values is None else F.col(col).isin(list(values))


def selection(f: BenchmarkFilters, with_dates: bool = True) -> Column:
    """The page filters: storage type, benchmark, scale factor (NULL exempt), labels, dates."""
    cond = (F.col("storage_type") == f.storage_type) & _in("benchmark", f.benchmarks)
    if f.sf_labels is not None:
        cond &= F.col("scale_factor").isNull() | F.col("scale_factor_label").isin(list(f.sf_labels))
    cond &= _in("machine_label", f.machines) & _in("cpu_arch_label", f.cpu_archs)
    if with_dates and f.start is not None:
        cond &= F.col("run_timestamp") >= F.lit(f.start).cast("timestamp_ntz")
    if with_dates and f.end is not None:
        cond &= F.col("run_timestamp") <= F.lit(f.end).cast("timestamp_ntz")
    return cond


def benchmark_options(geomean: DataFrame) -> DataFrame:
    """Benchmark filter values."""
    return views.benchmark_list(geomean).select("benchmark")


def sf_options(geomean: DataFrame) -> DataFrame:
    """Scale-factor filter values (real scale factors only)."""
    return views.scale_factor_list(geomean).select("scale_factor_label")


def machine_options(geomean: DataFrame) -> DataFrame:
    return views.machine_list(geomean).select("machine_label")


def cpu_arch_options(geomean: DataFrame) -> DataFrame:
    return views.cpu_arch_list(geomean).select("cpu_arch_label")


def sf_applicable(geomean: DataFrame, f: BenchmarkFilters) -> DataFrame:
    """Number of runs with a scale factor among the chosen benchmarks (hides the sf filter)."""
    return geomean.where(
        (F.col("storage_type") == f.storage_type)
        & _in("benchmark", f.benchmarks)
        & F.col("scale_factor").isNotNull()
    ).agg(F.count(F.lit(1)).alias("n"))


GEOMEAN_REPORT_COLUMNS = [
    "benchmark_series", "benchmark", "scale_factor_label", "run_timestamp", "run_date",
    "geomean_seconds", "engine_version", "commit", "machine_label", "cpu_arch_label",
    "queries_ok", "queries_attempted", "queries_failed", "is_complete", "query_set",
]


def geomean_report(geomean: DataFrame, f: BenchmarkFilters, ordered: bool = True) -> DataFrame:
    """The plotted runs: filtered, short commit and query-set ids, by timestamp."""
    out = geomean.where(selection(f)).select(
        "benchmark_series", "benchmark", "scale_factor_label", "run_timestamp", "run_date",
        "geomean_seconds", "engine_version",
        F.substring("engine_commit_sha", 1, fx.SHORT_ID_CHARS).alias("commit"),
        "machine_label", "cpu_arch_label", "queries_ok", "queries_attempted", "queries_failed",
        "is_complete",
        F.substring("queries_sha", 1, fx.SHORT_ID_CHARS).alias("query_set"),
    )
    return out.orderBy(F.col("run_timestamp").asc_nulls_last()) if ordered else out


def version_baselines(geomean: DataFrame, f: BenchmarkFilters) -> DataFrame:
    """Latest geomean per (series, pinned version); not limited by the date range.

    Latest = greatest (timestamp, run_id), so equal timestamps resolve the same way
    every time; NULL geomeans are skipped.
    """
    g = geomean.where(
        selection(f, with_dates=False)
        & F.col("engine_version").isin(list(f.pinned_versions))
        & F.col("geomean_seconds").isNotNull()
    )
    # first of each group in one pass: tasks keep one row a group before the shuffle
    newest = Window.partitionBy("benchmark_series", "engine_version").orderBy(
        F.col("run_timestamp").desc_nulls_last(), F.col("run_id").desc_nulls_last()
    )
    return (
        g.withColumn("_r", F.row_number().over(newest))
        .where(F.col("_r") == 1)
        .select("benchmark_series", "engine_version", F.col("geomean_seconds").alias("baseline_seconds"))
        .orderBy(F.col("benchmark_series").asc_nulls_last(), F.col("engine_version").asc_nulls_last())
    )


def chart_bounds(report: DataFrame, baselines: DataFrame) -> DataFrame:
    """Per series: the tallest point or baseline times 1.08."""
    ys = report.select("benchmark_series", F.col("geomean_seconds").alias("y")).unionByName(
        baselines.select("benchmark_series", F.col("baseline_seconds").alias("y"))
    )
    return ys.groupBy("benchmark_series").agg((F.max("y") * F.lit(HEADROOM)).alias("y_max"))


def series_shown(report: DataFrame) -> DataFrame:
    return (
        report.select("benchmark_series")
        .distinct()
        .orderBy(F.col("benchmark_series").asc_nulls_last())
    )


def run_table(report: DataFrame) -> DataFrame:
    """The runs table: geomean rounded to 4 places, newest first."""
    return report.orderBy(F.col("run_timestamp").desc_nulls_last()).select(
        "benchmark_series", "run_date", "engine_version", "commit",
        round_half_away(F.col("geomean_seconds"), 4).alias("geomean_s"),
        F.col("queries_ok").alias("n_ok"),
        F.col("queries_failed").alias("n_failed"),
        "machine_label", "cpu_arch_label", "query_set",
    )


def run_options(geomean: DataFrame, f: BenchmarkFilters) -> DataFrame:
    """Run choices: 'date  -  series  -  version', newest first (ties by run_id)."""
    return (
        geomean.where(selection(f))
        .select(
            "run_id",
            F.concat(
                F.col("run_date"), F.lit(fx.RUN_LABEL_SEPARATOR), F.col("benchmark_series"),
                F.lit(fx.RUN_LABEL_SEPARATOR),
                F.col("engine_version"),
            ).alias("run_label"),
            "run_timestamp",
        )
        .orderBy(F.col("run_timestamp").desc_nulls_last(), F.col("run_id").desc_nulls_last())
    )


#: Baselines are kept for each of these.
BASELINE_KEYS = ["benchmark_series", "query", "engine_version"]
#: Size of the quantile sketches, and the share of a group by which a median from them may be off in rank.
SKETCH_K, SKETCH_ERROR = 800, 0.01


def baseline_medians(query_times: DataFrame, f: BenchmarkFilters) -> DataFrame:
    """Median of the per-run medians per (series, query, pinned version).

    Pools machines, architectures and dates. A group holds every run of a release,
    so it grows with the data: the exact median spreads every group over tasks by
    value range (no group is gathered into one task).
    """
    return exact_median(pinned_times(query_times, f), BASELINE_KEYS, "median_seconds", "baseline_seconds")


def pinned_times(query_times: DataFrame, f: BenchmarkFilters) -> DataFrame:
    """Rows of the storage type and the pinned versions (of query times, or of sketches of them)."""
    pinned = F.col("engine_version").isin(list(f.pinned_versions))
    return query_times.where((F.col("storage_type") == f.storage_type) & pinned)


def baseline_sketches(query_times: DataFrame) -> DataFrame:
    """A quantile sketch of the per-run medians per storage type, BASELINE_KEYS and day of the run.

    Stored beside the query times, the sketches of new days are appended and no old timing is
    read again. Each is a partial aggregate of bounded size, so a hot release costs no task more.
    """
    day = F.col("run_timestamp").cast("date").alias("run_day")
    rows = query_times.where(F.col("median_seconds").isNotNull())
    sketch = F.kll_sketch_agg_double("median_seconds", SKETCH_K).alias("sketch")
    return rows.groupBy("storage_type", *BASELINE_KEYS, day).agg(sketch)


def merged_baselines(sketches: DataFrame, f: BenchmarkFilters) -> DataFrame:
    """:func:`baseline_medians` from stored sketches, approximately.

    ``baseline_seconds`` is a value that occurs, and its rank is off the middle by at most SKETCH_ERROR of the
    group's size but for a chance well below one in a million.
    """
    whole = pinned_times(sketches, f).groupBy(*BASELINE_KEYS).agg(F.kll_merge_agg_double("sketch", SKETCH_K).alias("_sketch"))
    return whole.select(*BASELINE_KEYS, F.kll_sketch_get_quantile_double("_sketch", F.lit(0.5)).alias("baseline_seconds"))


def matching_runs(runs: DataFrame, f: BenchmarkFilters) -> DataFrame:
    """The rows of ``runs`` that the filters select, before any timing is looked at."""
    labelled = derived.run_labels(runs).withColumn("run_timestamp", F.col("run_ts"))
    return labelled.where(selection(f)).select(*runs.columns)


def selected_run(geomean: DataFrame, f: BenchmarkFilters) -> DataFrame:
    """One-row frame with the chosen run id (the parameter, else the newest option)."""
    if f.run_id:
        return geomean.sparkSession.range(1).select(F.lit(f.run_id).alias("run_id"))
    # top-1 by a global order: TakeOrderedAndProject keeps one row per task
    return (
        geomean.where(selection(f))
        .select("run_id", "run_timestamp")
        .orderBy(F.col("run_timestamp").desc_nulls_last(), F.col("run_id").desc_nulls_last())
        .limit(1)
        .select("run_id")
    )


def query_times_report(
    geomean: DataFrame,
    query_times: DataFrame,
    f: BenchmarkFilters,
    baseline_times: DataFrame | None = None,
    baseline_from: DataFrame | None = None,
) -> DataFrame:
    """The chosen run's queries against the pinned baselines, regressions first.

    Ratios are rounded to 2 places and the flags compare that rounded value, so a
    flag never disagrees with the shown number: +1 above 1.1, -1 below 0.9, else NULL.
    ``baseline_times`` (default ``query_times``) is where the baseline medians come
    from; with ``baseline_from``, stored :func:`baseline_sketches`, they are approximate and no older
    timing is read. An empty or unset ``f.run_id`` means the newest run that matches the filters.
    """
    primary, secondary = f.pinned_versions[0], f.pinned_versions[1]
    of_type = query_times.where(F.col("storage_type") == f.storage_type)
    # a literal or a scalar subquery (one row by its limit) on the key of every step below: the
    # filter reaches the scans, so only the chosen run's timings are aggregated
    sel = of_type.where(F.col("run_id") == (F.lit(f.run_id) if f.run_id else selected_run(geomean, f).scalar()))
    if baseline_from is not None:
        base = merged_baselines(baseline_from, f)
    else:
        base = baseline_medians(query_times if baseline_times is None else baseline_times, f)
    # both releases from one aggregate: one row per (series, query)
    sides = base.groupBy("benchmark_series", "query").agg(
        F.max(F.when(F.col("engine_version") == primary, F.col("baseline_seconds"))).alias("_b_p"),
        F.max(F.when(F.col("engine_version") == secondary, F.col("baseline_seconds"))).alias("_b_s"),
    )
    j = sel.join(sides, ["benchmark_series", "query"], "left")

    def ratio(tag: str) -> Column:
        b = F.col(f"_b_{tag}")
        return round_half_away(F.col("median_seconds") / F.when(b != 0, b), 2)

    def flag(r: Column) -> Column:
        return F.when(r > RATIO_HIGH, F.lit(1)).when(r < RATIO_LOW, F.lit(-1))

    out = j.select(
        "query",
        round_half_away(F.col("median_seconds"), 4).alias("median_s"),
        round_half_away(F.col("_b_p"), 4).alias("primary_baseline_s"),
        round_half_away(F.col("_b_s"), 4).alias("secondary_baseline_s"),
        ratio("p").alias("primary_ratio"),
        ratio("s").alias("secondary_ratio"),
        F.col("timed_runs").alias("warm_runs"),
        "status",
        F.col("median_seconds").alias("_m"),
    )
    out = out.withColumns(
        {"primary_flag": flag(F.col("primary_ratio")), "secondary_flag": flag(F.col("secondary_ratio"))}
    )
    return out.orderBy(
        F.coalesce("primary_ratio", "secondary_ratio").desc_nulls_last(),
        F.col("_m").desc_nulls_last(),
    ).select(
        "query", "median_s", "primary_baseline_s", "secondary_baseline_s", "primary_ratio",
        "secondary_ratio", "primary_flag", "secondary_flag", "warm_runs", "status",
    )


def run_counts(runs: DataFrame) -> DataFrame:
    """Non-test runs per (benchmark, benchmark_name, scale_factor); NULL is_test is dropped."""
    return (
        runs.where(~F.col("is_test"))
        .groupBy("benchmark", "benchmark_name", "scale_factor")
        .agg(F.count(F.lit(1)).alias("n_runs"))
    )
