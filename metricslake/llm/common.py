"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python hold at most this many rows (whole texts stay small in memory).
BATCH_ROWS = 2000


_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Give the package to the executors' Python, unless PYTHONPATH names its folder."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _sent or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp(prefix="metricslake-package-")  # read by the driver's file server only
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/metricslake", "zip", root, "metricslake"))
    _sent.add(app)


def prepare(spark: SparkSession) -> SparkSession:
    """Session options the operators rely on (session scoped), and their code."""
    send_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    A local session that names none (tests) gets a scratch folder; a cluster session
    without the setting is an error, since no other folder is known to be shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    scratch = tempfile.mkdtemp(prefix="metricslake-llm-")
    spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/metricslake-llm/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, so a lost executor
    costs a read and not the whole job."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of ``written`` tables that nothing reads any more."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def thinned(rows: DataFrame, group: str, pick: str, wanted: int) -> DataFrame:
    """About ``2 * wanted`` rows of each group (all of a smaller one), those with the smallest
    ``pick``, a uniform hash: a bounded set to draw a sample of ``wanted`` rows from.

    Groups are counted in a partial aggregate and rows are filtered where they are read, so
    no group meets in one task. There is one count for each group to broadcast.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("_rows"))
    place = F.pmod(F.col(pick), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return rows.join(F.broadcast(counts), group).filter(place <= F.lit(2.0 * wanted) / F.col("_rows")).drop("_rows")


def lean(run):
    """A task's function over Arrow batches that gives freed memory back to the system when it ends:
    Python workers live on for later tasks, beside the executor's JVM."""

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return trimmed


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished plans now: it does so for plans
    that the driver's garbage collection finds unused, which may not run for a long time."""
    gc.collect()
    spark._jvm.System.gc()
