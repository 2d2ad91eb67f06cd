"""Structured Streaming forms of the two feeds.

``landing_stream``: run batches (JSON arrays) dropped in a landing folder ->
contiguity gate -> completed prefix -> runs table + marks table. Runs of a landing that does not
connect to what is stored are held, and land when later landings close the gap.
``late_period_load``: weekly download files -> skip stored periods -> unpivot ->
download table.

Both run with ``trigger(availableNow=True)`` (process what has landed, then stop)
or a processing-time trigger, with a checkpoint in the shared checkpoint folder.

Exactly-once without multi-table transactions: every micro-batch writes into
partitions named by its batch id (runs, marks) or by its period (downloads) with
dynamic partition overwrite, and reads only state written by *earlier* batches. A
batch that is replayed after a failure recomputes the same rows and overwrites the
same partitions, so a replay adds nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from metricslake.operators import ingest
from metricslake.schemas import CI_REPOSITORIES_METADATA, CI_RUNS, EXTENSION_DOWNLOADS
from metricslake.session import checkpoint_dir
from metricslake.sources import download_files as dl
from metricslake.sources import lake, published

BATCH_COL = "landing_batch"
MARKS_TABLE = T.StructType(CI_REPOSITORIES_METADATA.fields + [T.StructField(BATCH_COL, T.LongType())])
REJECTS_TABLE = T.StructType(
    [
        T.StructField("repository", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField(BATCH_COL, T.LongType()),
    ]
)
RETRY_TABLE = T.StructType(
    [T.StructField("repository_id", T.LongType()), T.StructField(BATCH_COL, T.LongType())]
)
#: The landing (a batch id) that a held run came with, and the landings that have been released by a batch.
LANDING_COL = "landing"
RELEASED_TABLE = T.StructType(
    [
        T.StructField("repository_id", T.LongType()),
        T.StructField(LANDING_COL, T.LongType()),
        T.StructField(BATCH_COL, T.LongType()),
    ]
)
#: Name of the column with a landed record as a whole.
RECORD_COL = "record"


def _write_partitions(df: DataFrame, path: str, partition_cols: list[str]) -> None:
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_cols)
        .parquet(path)
    )


def marks_before_batch(spark: SparkSession, marks_path: str, batch_id: int) -> DataFrame:
    """Per repository, the largest stored run id written by batches before ``batch_id``."""
    m = lake.read_or_empty(spark, marks_path, MARKS_TABLE)
    return (
        m.where(F.col(BATCH_COL) < batch_id)
        .groupBy("repository_id")
        .agg(F.max("max_run_id").alias("max_run_id"))
    )


def next_batch_id(spark: SparkSession, *table_paths: str) -> int:
    """One more than the largest batch id in any of the tables (0 for none)."""
    empty = T.StructType([T.StructField(BATCH_COL, T.LongType())])
    largest = [
        lake.read_or_empty(spark, path, empty).agg(F.max(BATCH_COL).cast("long")).first()[0] for path in table_paths
    ]
    return max((b + 1 for b in largest if b is not None), default=0)


BATCH_TIMES = T.StructType([T.StructField("as_of", T.TimestampNTZType()), T.StructField(BATCH_COL, T.LongType())])


def batch_time(spark: SparkSession, path: str, batch_id: int, now: dt.datetime) -> dt.datetime:
    """The time a batch counts from: ``now`` when it is first tried, the stored time in a replay."""
    stored = lake.read_or_empty(spark, path, BATCH_TIMES).where(F.col(BATCH_COL) == batch_id).select("as_of").first()
    if stored is not None:
        return stored[0]
    _write_partitions(spark.createDataFrame([(now, batch_id)], BATCH_TIMES), path, [BATCH_COL])
    return now


def held_tables(runs_path: str) -> tuple[str, str]:
    """Where the runs that wait, and the landings that no longer do, are kept beside the runs."""
    return f"{runs_path}_held", f"{runs_path}_released"


def held_runs(spark: SparkSession, runs_path: str, schema: T.StructType = CI_RUNS, before_batch: int | None = None) -> DataFrame:
    """Runs of landings that wait to connect (as of ``before_batch``), with their landing."""
    held_path, released_path = held_tables(runs_path)
    fields = [f for f in schema.fields if f.name != BATCH_COL]
    held = lake.read_or_empty(spark, held_path, T.StructType([*fields, T.StructField(BATCH_COL, T.LongType())]), merge_schema=True)
    released = lake.read_or_empty(spark, released_path, RELEASED_TABLE)
    if before_batch is not None:
        held, released = (t.where(F.col(BATCH_COL) < before_batch) for t in (held, released))
    held = held.withColumn(LANDING_COL, F.col(BATCH_COL).cast("long")).drop(BATCH_COL)
    gone = released.select(F.col("repository_id").alias("_rid"), F.col(LANDING_COL).alias("_landing"))
    waits = (ingest.repo_id_col(held) == F.col("_rid")) & (F.col(LANDING_COL) == F.col("_landing"))
    return held.join(gone, waits, "left_anti")


def expire_held(spark: SparkSession, runs_path: str, before_batch: int) -> list[int]:
    """Delete the held runs of landings that batches before ``before_batch`` have released whole;
    returns those landings. The last batch must not be run again afterwards if it is one of them."""
    held_path, _ = held_tables(runs_path)
    if not lake.is_table(spark, held_path):
        return []
    waiting = {r[0] for r in held_runs(spark, runs_path, before_batch=before_batch).select(LANDING_COL).distinct().collect()}
    stored = {r[0] for r in lake.read_or_empty(spark, held_path, RETRY_TABLE).select(BATCH_COL).distinct().collect()}
    done = sorted(int(b) for b in stored - waiting if b is not None and b < before_batch)  # one for each batch that held runs
    for landing in done:
        lake.delete(spark, f"{held_path}/{BATCH_COL}={landing}")
    return done


def store_run_batch(
    spark: SparkSession,
    batch: DataFrame,
    batch_id: int,
    runs_path: str,
    marks_path: str,
    retry_path: str,
    as_of: dt.datetime,
    stale_hours: int | None = ingest.STALE_HOURS,
) -> None:
    """One micro-batch of landed runs (all repositories at once); of a run that several
    landings hold, the newest copy counts.

    What waits from earlier batches takes part in the gate. Of a repository whose landing does not connect
    nothing is stored; its runs are held under this batch and the repository is listed for a
    retry. A batch that is run again reads the state of earlier batches and rewrites its own partitions.
    """
    held_path, released_path = held_tables(runs_path)
    marks = marks_before_batch(spark, marks_path, batch_id)
    waiting = held_runs(spark, runs_path, batch.schema, batch_id)
    landed = batch.withColumn(LANDING_COL, F.lit(batch_id).cast("long"))
    gate = ingest.connect_landings(landed.unionByName(waiting, allowMissingColumns=True), marks, LANDING_COL)
    newest = ingest.newest_copies(gate.accepted.drop(LANDING_COL))
    commit_runs_and_mark(ingest.completed_prefix(newest, marks, as_of, stale_hours), batch_id, runs_path, marks_path)
    tag = F.lit(batch_id).cast("long").alias(BATCH_COL)
    own = F.col(LANDING_COL) == batch_id
    _write_partitions(gate.held.where(own).drop(LANDING_COL).select("*", tag), held_path, [BATCH_COL])
    released = gate.landings.where(F.col("connected") & ~own).select("repository_id", LANDING_COL, tag)
    _write_partitions(released, released_path, [BATCH_COL])
    retry = gate.landings.where(~F.col("connected") & own).select("repository_id", tag)
    _write_partitions(retry, retry_path, [BATCH_COL])


def commit_runs_and_mark(kept: DataFrame, batch_id: int, runs_path: str, marks_path: str) -> None:
    """Store the kept runs and then their new marks, both under ``batch_id``.

    Spark has no transaction over two tables; instead both writes replace the
    partition of this batch only, data first and marks second. A failure between
    them leaves runs whose marks are missing; rerunning the same batch rewrites
    the same two partitions, so the pair ends up consistent and nothing doubles.
    """
    # the kept rows feed two writes: materialize once in the shared checkpoint folder
    kept = kept.checkpoint(eager=True)
    tag = F.lit(batch_id).cast("long").alias(BATCH_COL)
    _write_partitions(kept.select("*", tag), runs_path, [BATCH_COL])
    _write_partitions(ingest.new_high_water_mark(kept).select("*", tag), marks_path, [BATCH_COL])


#: Names of the tables that :func:`publish_runs_and_mark` changes together.
RUNS, MARKS = "ci_runs", "ci_runs_marks"


def publish_runs_and_mark(kept: DataFrame, batch_id: int, root: str) -> bool:
    """Runs and their new marks in one step (:mod:`metricslake.sources.published`): a reader sees both
    or neither. A batch that has been published already adds nothing (False)."""
    spark = kept.sparkSession
    now = published.state(spark, root)
    if now.step is not None and batch_id <= now.step:
        return False
    kept = kept.checkpoint(eager=True)
    changes = {RUNS: kept, MARKS: ingest.new_high_water_mark(kept)}
    return published.publish(spark, root, append=changes, step=batch_id, base=now)


def whole_records(files: DataFrame, schema: T.StructType = CI_RUNS, record_col: str = RECORD_COL, text_col: str = "value") -> DataFrame:
    """Landed files (a JSON array of records each) -> one row a record: the columns of ``schema`` in
    their types, and the whole record as a variant, so fields that the model does not name are kept
    whenever they appear. A file that is no JSON array or object of this kind is an error."""
    strict = {"mode": "FAILFAST"}
    typed = F.from_json(F.col(text_col), T.ArrayType(schema), strict).alias("_typed")
    records = F.from_json(F.col(text_col), "array<variant>", strict).alias("_record")
    rows = files.select(typed, records).select(F.inline(F.arrays_zip("_typed", "_record")))
    return rows.select("_typed.*", F.col("_record").alias(record_col))


def landing_stream(
    spark: SparkSession,
    landing_dir: str,
    lake_root: str,
    as_of: Callable[[], dt.datetime] | dt.datetime,
    checkpoint: str | None = None,
    available_now: bool = True,
    processing_time: str | None = None,
    schema: T.StructType = CI_RUNS,
    record_col: str | None = RECORD_COL,
) -> StreamingQuery:
    """Continuously store landed CI runs; returns the started query.

    ``schema`` names the fields that are stored in columns of their own (the model's among them); the
    whole record, with every field it has, is stored as a variant in ``record_col``
    (none: only the columns). The time of a batch is stored with its id, so a replay uses the same one.
    """
    root = lake_root.rstrip("/")
    runs_path, marks_path, retry_path = f"{root}/ci_runs", f"{root}/ci_runs_marks", f"{root}/ci_runs_retry"
    checkpoint = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/landing_stream"
    if record_col is None:
        source = spark.readStream.schema(schema).option("multiLine", True).json(landing_dir)
    else:
        source = whole_records(spark.readStream.option("wholetext", True).text(landing_dir), schema, record_col)

    def handle(batch: DataFrame, batch_id: int) -> None:
        now = batch_time(spark, f"{root}/ci_runs_batches", batch_id, as_of() if callable(as_of) else as_of)
        store_run_batch(spark, batch, batch_id, runs_path, marks_path, retry_path, now)

    writer = source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if processing_time:
        writer = writer.trigger(processingTime=processing_time)
    elif available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def store_period_batch(
    spark: SparkSession, files: DataFrame, table_path: str, rejects_path: str, batch_id: int,
    legacy_key: bool = False,
) -> None:
    """One micro-batch of weekly files: skip stored periods, unpivot, write by period."""
    periods = dl.parse_period_path(files)
    stored = lake.read_or_empty(spark, table_path, EXTENSION_DOWNLOADS)
    fresh = dl.skip_stored_periods(periods.valid, stored.select("year", "week", "repository"), legacy_key)
    counts = dl.unpivot_download_counts(fresh)
    # the new rows are computed from the table they go to: materialize them first
    new_rows = counts.valid.checkpoint(eager=True)
    # partitioned by period: a replayed batch rewrites exactly the periods it wrote
    _write_partitions(new_rows, table_path, ["repository", "year", "week"])
    rejected = periods.rejected.drop("text").unionByName(
        counts.rejected.drop("text"), allowMissingColumns=True
    )
    _write_partitions(
        rejected.select("repository", "file_path", "reason", F.lit(batch_id).cast("long").alias(BATCH_COL)),
        rejects_path,
        [BATCH_COL],
    )


def late_period_load(
    spark: SparkSession,
    roots: dict[str, str],
    table_path: str,
    checkpoint: str | None = None,
    available_now: bool = True,
    legacy_key: bool = False,
) -> StreamingQuery:
    """Load weekly download files as they arrive, each period once per repository."""
    checkpoint = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/late_period_load"
    streams = []
    for repository, root in roots.items():
        streams.append(
            spark.readStream.option("wholetext", True)
            .text(f"{root.rstrip('/')}/{dl.STATS_DIR}/*/*")
            .select(
                F.lit(repository).alias("repository"),
                F.col("_metadata.file_path").alias("file_path"),
                F.col("value").alias("text"),
            )
        )
    source = streams[0]
    for s in streams[1:]:
        source = source.unionByName(s)
    rejects_path = table_path.rstrip("/") + "_rejects"

    def handle(batch: DataFrame, batch_id: int) -> None:
        store_period_batch(spark, batch, table_path, rejects_path, batch_id, legacy_key)

    writer = source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
