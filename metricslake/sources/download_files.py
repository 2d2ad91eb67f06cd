"""Weekly download-count files: ``<root>/download-stats-weekly/<year>/<week>.json``.

Each file is one JSON object ``{"_last_update": ts, "<extension>": count, ...}``.
Files are read whole (one row per file, spread over tasks by Spark's file
listing), parsed into a map and exploded to one row per extension. Nothing goes
through the driver; Spark's glob lists every file.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricslake import fixed as fx
from metricslake.schemas import EXTENSION_DOWNLOADS
from metricslake.sources import lake

STATS_DIR = fx.STATS_DIR
LAST_UPDATE_KEY = fx.LAST_UPDATE_KEY
#: Tasks that write weekly files.
WRITE_TASKS = 32
# <year: four digits>/<week: digits>.json at the end of the path (fixed pattern)
PERIOD_PATH = STATS_DIR + r"/(\d{4})/(\d+)\.json\z"


@dataclass(frozen=True)
class Parsed:
    valid: DataFrame
    rejected: DataFrame  # rows with a reason column


def _whole_files(spark: SparkSession, repository: str, paths: list[str]) -> DataFrame:
    return (
        spark.read.option("wholetext", True)
        .text(paths)
        .select(
            F.lit(repository).alias("repository"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("value").alias("text"),
        )
    )


def read_stat_files(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """(repository, file_path, text): every file below each root, tagged with its repository."""
    frames = [_whole_files(spark, repository, [f"{root.rstrip('/')}/{STATS_DIR}/*/*"]) for repository, root in roots.items()]
    return reduce(DataFrame.unionByName, frames)


def read_new_files(spark: SparkSession, roots: dict[str, str], stored: DataFrame, legacy_key: bool = False) -> DataFrame:
    """Like :func:`read_stat_files`, without the files of stored periods: those are not opened.

    Periods are told by the paths alone. A calendar bounds them (53 a year and repository), so the
    stored ones and the listing are compared on the driver.
    """
    rows = stored.select("year", "week", "repository").distinct().collect()
    known = {(r["year"], r["week"], None if legacy_key else r["repository"]) for r in rows}
    frames = []
    for repository, root in roots.items():
        fresh = []
        for path in lake.list_files(spark, f"{root.rstrip('/')}/{STATS_DIR}/*/*"):
            period = re.search(PERIOD_PATH.replace(r"\z", r"\Z"), path)
            key = period and (int(period[1]), int(period[2]), None if legacy_key else repository)
            if key not in known:  # a path without a period is read, to be rejected with a reason
                fresh.append(lake.as_glob(path))
        if fresh:
            frames.append(_whole_files(spark, repository, fresh))
    if not frames:
        return spark.createDataFrame([], "repository string, file_path string, text string")
    return reduce(DataFrame.unionByName, frames)


def write_stat_files(downloads: DataFrame, roots: dict[str, str]) -> int:
    """Write stored rows as weekly files, one for each period, below the root of their repository; returns how
    many. Spark writes a part file for each period, which is then renamed to the name of its week."""
    spark = downloads.sparkSession
    staging = f"{next(iter(roots.values())).rstrip('/')}/_staging_{uuid.uuid4().hex}"
    files = download_files_from_table(downloads.where(F.col("repository").isin(*roots)))
    dealt = files.select("text", "repository", "year", "week").repartition(WRITE_TASKS, "repository", "year", "week")
    dealt.write.partitionBy("repository", "year", "week").text(staging)
    parts, folders = lake.list_files(spark, f"{staging}/*/*/*/part-*"), set()
    for part in parts:
        repository, year, week = (piece.split("=", 1)[1] for piece in part.split("/")[-4:-1])
        folder = f"{roots[repository].rstrip('/')}/{STATS_DIR}/{year}"
        if folder not in folders:
            lake.make_folder(spark, folder)
            folders.add(folder)
        lake.rename(spark, part, f"{folder}/{week}.json")
    lake.delete(spark, staging)
    return len(parts)


def parse_period_path(files: DataFrame, path_col: str = "file_path") -> Parsed:
    """(year, week) from the path; the year must have four digits and the week be 1..53."""
    path = F.col(path_col)
    year_txt = F.regexp_extract(path, PERIOD_PATH, 1)
    week_txt = F.regexp_extract(path, PERIOD_PATH, 2)
    week = F.when(week_txt != "", week_txt.cast("int"))
    ok = (year_txt != "") & week.between(fx.WEEK_FIRST, fx.WEEK_LAST)
    tagged = files.withColumns(
        {"year": F.when(ok, year_txt.cast("int")), "week": F.when(ok, week)}
    )
    return Parsed(
        tagged.where(ok),
        tagged.where(~ok).withColumn("reason", F.lit("invalid period path")),
    )


def _last_update(m: Column) -> Column:
    return F.element_at(m, F.lit(LAST_UPDATE_KEY))


def unpivot_download_counts(files: DataFrame, text_col: str = "text") -> Parsed:
    """One row per (period file, extension); ``_last_update`` goes to every row.

    A file without ``_last_update`` (or not a JSON object) is rejected whole.
    """
    parsed = files.withColumn("_m", F.from_json(F.col(text_col), "map<string,string>"))
    has_ts = F.coalesce(F.map_contains_key(F.col("_m"), F.lit(LAST_UPDATE_KEY)), F.lit(False))
    good = parsed.where(has_ts)
    bad = parsed.where(~has_ts).drop("_m").withColumn("reason", F.lit("missing _last_update"))
    rows = good.select(
        "year",
        "week",
        "repository",
        _last_update(F.col("_m")).alias("_ts"),
        F.explode(F.map_filter("_m", lambda k, v: k != F.lit(LAST_UPDATE_KEY))).alias(
            "extension_name", "_count"
        ),
    )
    out = rows.select(
        F.col("year").cast("int").alias("year"),
        F.col("week").cast("int").alias("week"),
        "extension_name",
        F.col("_count").cast("long").alias("downloads"),
        F.to_timestamp_ntz(F.col("_ts")).alias("last_update"),
        "repository",
    )
    return Parsed(out.select(*EXTENSION_DOWNLOADS.fieldNames()), bad)


def skip_stored_periods(batch: DataFrame, stored: DataFrame, legacy_key: bool = False) -> DataFrame:
    """Drop batch rows whose period is already stored.

    The key is (year, week, repository). ``legacy_key=True`` uses (year, week) only,
    as the source feed does: there a community file arriving after the core file of
    the same week was stored is never loaded.
    """
    keys = ["year", "week"] if legacy_key else ["year", "week", "repository"]
    periods = stored.select(*keys).distinct()
    return batch.join(periods, keys, "left_anti")


def read_download_stats(
    spark: SparkSession, roots: dict[str, str], stored: DataFrame | None = None,
    legacy_key: bool = False,
) -> Parsed:
    """Files of all roots -> new extension download rows (rejects kept apart); files of
    periods in ``stored`` are not opened."""
    files = read_stat_files(spark, roots) if stored is None else read_new_files(spark, roots, stored, legacy_key)
    periods = parse_period_path(files)
    counts = unpivot_download_counts(periods.valid)
    rejected = periods.rejected.drop("text").unionByName(
        counts.rejected.drop("text"), allowMissingColumns=True
    )
    return Parsed(counts.valid, rejected)


def download_files_from_table(downloads: DataFrame) -> DataFrame:
    """Rebuild the weekly files as (repository, file_path, text) from stored rows.

    Used to exercise the file parsers on data derived from the tables: one JSON
    object per (year, week, repository) with ``_last_update`` = latest update.
    """
    per_file = downloads.groupBy("year", "week", "repository").agg(
        F.map_from_entries(
            F.collect_list(F.struct("extension_name", F.col("downloads").cast("string")))
        ).alias("_counts"),
        F.date_format(F.max("last_update"), "yyyy-MM-dd HH:mm:ss").alias("_ts"),
    )
    text = F.to_json(
        F.map_concat(F.create_map(F.lit(LAST_UPDATE_KEY), F.col("_ts")), F.col("_counts"))
    )
    path = F.format_string(
        "lake/%s/" + STATS_DIR + "/%d/%d.json", F.col("repository"), F.col("year"), F.col("week")
    )
    return per_file.select("repository", path.alias("file_path"), text.alias("text"), "year", "week")
