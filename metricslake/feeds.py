"""Feed runs in batch form: landed records -> operators -> lake tables.

The fetching side (API pages, object-store listings) is not part of this package:
records land as JSON files (or any DataFrame) and each function below stores one
landed batch. Table layout under ``lake_root``:

    ci_repositories, ci_workflows         replaced by change-only upserts
    ci_runs, ci_runs_marks, ci_runs_retry  partitions per landing batch (see streaming)
    ci_runs_held, ci_runs_released         runs that wait to connect, and those that no longer do
    ci_jobs                               appended
    extension_downloads                   partitions per (repository, year, week)

``run_all_feeds`` runs feeds one after another; a ValueError or AssertionError of one
feed becomes a warning and the next feed still runs, anything else stops the run.

Batch runs number their landing batches one after another, the stream
(``streaming.landing``) takes its micro-batch numbers; marks are read from
lower-numbered batches, so one set of run tables is written by one of the two only.
"""

from __future__ import annotations

import datetime as dt
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricslake.operators import changes, ingest
from metricslake.schemas import CI_JOBS, CI_REPOSITORIES, CI_RUNS, EXTENSION_DOWNLOADS
from metricslake.sources import download_files as dl
from metricslake.sources import lake
from metricslake.streaming.landing import (
    BATCH_COL,
    REJECTS_TABLE,
    RETRY_TABLE,
    next_batch_id,
    store_period_batch,
    store_run_batch,
)


def _path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def _typed(value: Column, landed: T.DataType, wanted: T.DataType) -> Column:
    """A landed value in the model's type; structs by field name, with their other fields after the model's."""
    if not (isinstance(wanted, T.StructType) and isinstance(landed, T.StructType)):
        return value.cast(wanted)
    types = {f.name: f.dataType for f in landed}
    known = [
        (_typed(value[f.name], types[f.name], f.dataType) if f.name in types else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in wanted
    ]
    others = [value[n].alias(n) for n in types if n not in wanted.fieldNames()]
    return F.when(value.isNotNull(), F.struct(*known, *others))


def typed_records(landed: DataFrame, schema: T.StructType) -> DataFrame:
    """Landed records with every field they have: the model's columns first, in their types
    (null where a record lacks one), then the others as they are."""
    types = {f.name: f.dataType for f in landed.schema}
    known = [
        (_typed(F.col(f.name), types[f.name], f.dataType) if f.name in types else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema
    ]
    return landed.select(*known, *[c for c in landed.columns if c not in schema.fieldNames()])


def _same_columns(batch: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both frames with the columns of either, null where one lacks a column."""
    for f in batch.schema:
        if f.name not in target.columns:
            target = target.withColumn(f.name, F.lit(None).cast(f.dataType))
    for f in target.schema:
        if f.name not in batch.columns:
            batch = batch.withColumn(f.name, F.lit(None).cast(f.dataType))
    return batch, target


def _upsert_table(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], name: str) -> int:
    """Create the table from the first batch, later merge only changed rows; returns the
    number of new or changed rows (0 writes nothing)."""
    lake.require_non_empty(spark, path, name)
    if not lake.is_table(spark, path):
        lake.create_table_as(spark, path, batch)
        return lake.read_lake_table(spark, path).count()
    batch, target = _same_columns(batch, lake.read_lake_table(spark, path))
    touched = target.join(batch.select(*keys).distinct(), keys, "left_semi").select(*target.columns)
    changed = changes.changed_rows(batch, touched).count()  # compares rows with a key of the batch only
    if changed:
        lake.replace_table(spark, path, changes.upsert_changed(target, batch, keys))
    return changed


def update_repositories(spark: SparkSession, lake_root: str, repos: DataFrame) -> int:
    """Upsert the repository list on ``id``; an empty list is an error."""
    if repos.isEmpty():
        raise ValueError("no repositories landed")
    batch = typed_records(repos, CI_REPOSITORIES)
    return _upsert_table(spark, _path(lake_root, "ci_repositories"), batch, ["id"], "ci_repositories")


def update_workflows(spark: SparkSession, lake_root: str, workflows: DataFrame, repo_col: str) -> int:
    """Tag workflows with their repository and upsert on (id, repository).

    A repository name that is not 'org/name' stops the feed (AssertionError), before
    anything is written.
    """
    valid, rejected = ingest.tag_with_repository(workflows.withColumnRenamed(repo_col, "_repo"), "_repo")
    bad = rejected.select("repository").limit(1).collect()
    if bad:
        raise AssertionError(f"invalid org/repo_name: {bad[0][0]!r}")
    batch = valid.drop("_repo")
    if batch.isEmpty():
        return 0
    return _upsert_table(spark, _path(lake_root, "ci_workflows"), batch, ["id", "repository"], "ci_workflows")


def update_runs(
    spark: SparkSession,
    lake_root: str,
    landed: DataFrame,
    as_of: dt.datetime,
    batch_id: int | None = None,
) -> DataFrame:
    """Store one landed batch of runs of all repositories; returns repositories to retry.

    Every batch gets the next id; hand in the id of an earlier batch to run that one again,
    which rewrites its partitions. A repository to retry is landed again (reaching further back) and
    stored by another call, under an id of its own.
    """
    root = lake_root.rstrip("/")
    tables = [f"{root}/{t}" for t in ("ci_runs", "ci_runs_marks", "ci_runs_retry")]
    bid = next_batch_id(spark, *tables) if batch_id is None else batch_id
    store_run_batch(spark, typed_records(landed, CI_RUNS), bid, *tables, as_of)
    retry = lake.read_or_empty(spark, f"{root}/ci_runs_retry", RETRY_TABLE)
    return retry.where(F.col(BATCH_COL) == bid).drop(BATCH_COL)


def stored_runs(spark: SparkSession, lake_root: str) -> DataFrame:
    """Stored runs with every field they were landed with, null where a batch did not have it."""
    return lake.read_or_empty(spark, _path(lake_root, "ci_runs"), CI_RUNS, merge_schema=True).drop(BATCH_COL)


def jobs_to_fetch(
    spark: SparkSession, lake_root: str, as_of: dt.datetime, remaining: int, main_repo: str
) -> DataFrame:
    """(full_name, run_id) whose jobs to fetch now: completed, recent runs without jobs,
    the first ``budget(repo)`` of each repository in id order."""
    runs = stored_runs(spark, lake_root)
    jobs = lake.read_or_empty(spark, _path(lake_root, "ci_jobs"), CI_JOBS)
    repos = spark.read.parquet(_path(lake_root, "ci_repositories"))
    work = ingest.runs_without_jobs(runs, jobs, as_of)
    per_repo = ingest.run_ids_per_repo(repos, work)
    return ingest.budgeted_work(per_repo, repos.select("full_name"), remaining, main_repo)


def update_jobs(spark: SparkSession, lake_root: str, landed: DataFrame) -> None:
    """Append landed jobs (the first batch creates the table), stored by the month of their run, so
    that :func:`jobs_to_fetch` reads the months of recent runs only."""
    path = _path(lake_root, "ci_jobs")
    lake.require_non_empty(spark, path, "ci_jobs")
    batch = ingest.with_run_month(typed_records(landed, CI_JOBS), stored_runs(spark, lake_root))
    batch = batch.hint("rebalance", ingest.RUN_MONTH)
    if lake.is_table(spark, path):
        lake.append_records(spark, path, batch)
    else:
        batch.write.partitionBy(ingest.RUN_MONTH).parquet(path)


def update_downloads(
    spark: SparkSession, lake_root: str, roots: dict[str, str], batch_id: int = 0,
    legacy_key: bool = False,
) -> DataFrame:
    """Load weekly download files of every root whose period is not stored yet; returns
    the rejected files (bad path or missing ``_last_update``)."""
    table = _path(lake_root, "extension_downloads")
    stored = lake.read_or_empty(spark, table, EXTENSION_DOWNLOADS)
    files = dl.read_new_files(spark, roots, stored, legacy_key)
    store_period_batch(spark, files, table, table + "_rejects", batch_id, legacy_key)
    rejects = lake.read_or_empty(spark, table + "_rejects", REJECTS_TABLE)
    return rejects.where(F.col(BATCH_COL) == batch_id)


def run_all_feeds(feeds: list[tuple[str, Callable[[], object]]]) -> list[str]:
    """Run feeds in order; ValueError / AssertionError of a feed becomes a warning."""
    problems = []
    for name, feed in feeds:
        try:
            feed()
        except (ValueError, AssertionError) as e:
            msg = f"feed {name!r} failed: {e}"
            warnings.warn(msg, stacklevel=2)
            problems.append(msg)
    return problems
