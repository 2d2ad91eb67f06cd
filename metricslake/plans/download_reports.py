"""Extension download reports: top-N trends with running totals and week pivots.

Facts are read and aggregated once to weekly sums; an extension's weeks (at most 53 a
year of the chosen range) travel with its total through the top-N. Running sums are
windows partitioned by extension, never a global window. Pivot columns are the weeks of
the chosen range, so the shape of a pivot follows from its parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricslake import fixed as fx
from metricslake.params import DownloadFilters


def in_period(df: DataFrame, f: DownloadFilters, with_repo: bool = True) -> DataFrame:
    # bounds on the stored column besides the combined key: they prune files and row groups
    cond = F.col("year").between(f.from_year, f.to_year)
    cond &= (F.col("year") * 100 + F.col("week")).between(f.lo, f.hi)
    if with_repo:
        cond &= F.col("repository").like(f.repository)
    return df.where(cond)


def period_date(year: str = "year", week: str = "week"):
    """Jan 1 of the year plus 7 * (week - 1) days (not the ISO week start)."""
    return F.date_add(F.make_date(F.col(year), F.lit(1), F.lit(1)), (F.col(week) - 1) * 7)


def period_label(year: str = "year", week: str = "week"):
    return F.format_string(fx.PERIOD_LABEL_FORMAT, F.col(year), F.col(week))


def weeks(spark) -> DataFrame:
    """Week choices 1..52 of the page."""
    return spark.range(1, fx.WEEKS_OFFERED + 1).select(F.col("id").cast("int").alias("week"))


def _weekly(downloads: DataFrame, f: DownloadFilters) -> DataFrame:
    return in_period(downloads, f).groupBy("extension_name", "year", "week").agg(F.sum("downloads").alias("downloads"))


def _leaders(weekly: DataFrame, top_n: int) -> DataFrame:
    """The top N extensions by total, ties by name, each with its weeks."""
    if top_n < 1:
        raise ValueError(f"top_n must be positive, got {top_n}")
    return (
        weekly.groupBy("extension_name")
        .agg(F.sum("downloads").alias("_total"), F.collect_list(F.struct("year", "week", "downloads")).alias("_weeks"))
        .orderBy(F.col("_total").desc_nulls_last(), F.col("extension_name").asc_nulls_last())
        .limit(top_n)
    )


def top_n_extensions(downloads: DataFrame, f: DownloadFilters) -> DataFrame:
    """Names of the top N by summed downloads in the period; ties broken by name."""
    return _leaders(_weekly(downloads, f), f.top_n).select("extension_name")


def _weekly_top(downloads: DataFrame, f: DownloadFilters) -> DataFrame:
    top = _leaders(_weekly(downloads, f), f.top_n)
    return top.select(F.col("extension_name").alias("extension"), F.inline("_weeks"))


def top_n_downloads(downloads: DataFrame, f: DownloadFilters) -> DataFrame:
    """Weekly downloads and running total per top-N extension."""
    w = Window.partitionBy("extension").orderBy("year", "week").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        _weekly_top(downloads, f)
        .select(
            period_date().alias("period"),
            "extension",
            "downloads",
            F.sum("downloads").over(w).alias("cumulative_downloads"),
        )
        .orderBy(F.col("period").asc_nulls_last(), F.col("extension").asc_nulls_last())
    )


def extensions(downloads: DataFrame) -> DataFrame:
    return (
        downloads.select(F.col("extension_name").alias("extension"))
        .distinct()
        .orderBy(F.col("extension").asc_nulls_last())
    )


def extension_detail(downloads: DataFrame, f: DownloadFilters) -> DataFrame:
    """One extension: weekly downloads and running total (window over its weeks only)."""
    one = in_period(downloads, f).where(F.col("extension_name") == f.extension)
    weekly = one.groupBy("extension_name", "year", "week").agg(F.sum("downloads").alias("downloads"))
    w = Window.partitionBy("extension_name").orderBy("year", "week").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        weekly.select(
            "year",
            "week",
            period_date().alias("period"),
            "downloads",
            F.sum("downloads").over(w).alias("cumulative_downloads"),
        )
        .orderBy("year", "week")
        .select("period", "downloads", "cumulative_downloads")
    )


def period_columns(f: DownloadFilters) -> list[str]:
    """Labels of every week of the chosen range."""
    weeks = range(fx.WEEK_FIRST, fx.WEEK_LAST + 1)
    years = range(f.from_year, f.to_year + 1)
    return [fx.PERIOD_LABEL_FORMAT % (y, w) for y in years for w in weeks if f.lo <= y * 100 + w <= f.hi]


def _pivot_periods(long_form: DataFrame, value: str, f: DownloadFilters) -> DataFrame:
    """(extension, period, value) with one row per pair -> one column for each week of the range."""
    pivoted = long_form.groupBy("extension").pivot("period", period_columns(f)).agg(F.max(value))
    return pivoted.orderBy(F.col("extension").asc_nulls_last())


def top_n_weekly_pivot(downloads: DataFrame, f: DownloadFilters) -> DataFrame:
    """Extension x 'YYYY-Www' weekly sums; weeks without downloads are NULL."""
    weekly = _weekly_top(downloads, f).select("extension", period_label().alias("period"), "downloads")
    return _pivot_periods(weekly, "downloads", f)


def top_n_cumulative_pivot(downloads: DataFrame, f: DownloadFilters) -> DataFrame:
    """Extension x 'YYYY-Www' running totals; weeks without downloads are NULL."""
    w = Window.partitionBy("extension").orderBy("period").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    cum = (
        _weekly_top(downloads, f)
        .withColumn("period", period_label())
        .select("period", "extension", F.sum("downloads").over(w).alias("cumulative_downloads"))
    )
    return _pivot_periods(cum, "cumulative_downloads", f)


def raw_downloads(downloads: DataFrame, f: DownloadFilters) -> DataFrame:
    return (
        in_period(downloads, f)
        .select(
            "year",
            "week",
            F.col("extension_name").alias("extension"),
            "downloads",
            "repository",
            "last_update",
        )
        .orderBy(
            F.col("year").desc_nulls_last(),
            F.col("week").desc_nulls_last(),
            F.col("extension").asc_nulls_last(),
            F.col("repository").asc_nulls_last(),
        )
    )
