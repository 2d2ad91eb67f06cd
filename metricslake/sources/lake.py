"""Lake tables as Parquet directories: create, append, replace, copy, materialize, compact.

Paths go through the Hadoop FileSystem of the session, so the same code works on
a local disk, HDFS or an object store. Replacing a table that may be read while it
is rewritten writes a new directory first and swaps it in afterwards.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from metricslake.session import checkpoint_dir


# ---- filesystem helpers (JVM Hadoop FileSystem) -------------------------------------


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def rename(spark: SparkSession, src: str, dst: str) -> None:
    fs, p = _fs(spark, src)
    jvm = spark.sparkContext._jvm
    if not fs.rename(p, jvm.org.apache.hadoop.fs.Path(dst)):
        raise OSError(f"rename failed: {src} -> {dst}")


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of the files that a glob pattern names, in order."""
    fs, p = _fs(spark, pattern)
    return sorted(str(s.getPath()) for s in fs.globStatus(p) or () if s.isFile())


def modified(spark: SparkSession, pattern: str) -> list[tuple[str, float]]:
    """Paths that a glob pattern names, with the seconds since the epoch of their last change."""
    fs, p = _fs(spark, pattern)
    return [(str(s.getPath()), s.getModificationTime() / 1000) for s in fs.globStatus(p) or ()]


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file as a whole."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file that must not exist yet."""
    fs, p = _fs(spark, path)
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def as_glob(path: str) -> str:
    """A pattern that names just this path."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def total_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength())


def _siblings(spark: SparkSession, path: str, mark: str) -> list[str]:
    """Directories that a replacement of ``path`` has put beside it."""
    fs, p = _fs(spark, f"{path.rstrip('/')}.__{mark}_*")
    return sorted(str(s.getPath()) for s in fs.globStatus(p) or ())


def recover(spark: SparkSession, path: str) -> None:
    """Finish a replacement that stopped while its table had no directory.

    A replacement names what it puts beside the table by one tag: the new directory, and the old
    one, moved away after the new one has been written. So only a pair of one tag tells of such a
    stop (if the new one is not whole, the old one comes back); anything else beside the table is left
    from earlier and never put in place.
    """
    if exists(spark, path):
        return
    for old in _siblings(spark, path, "old"):
        new = old.replace(".__old_", ".__new_")
        if exists(spark, new):
            _moved(spark, new if exists(spark, f"{new}/_SUCCESS") else old, path)
            return


def _moved(spark: SparkSession, src: str, dst: str) -> None:
    """Rename, unless another reader or the writer itself has done so in the meantime."""
    try:
        rename(spark, src, dst)
    except (OSError, Py4JError):
        if exists(spark, src) or not exists(spark, dst):
            raise


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table and everything that replacements have left beside it."""
    for leftover in [*_siblings(spark, path, "old"), *_siblings(spark, path, "new"), path]:
        delete(spark, leftover)


def is_table(spark: SparkSession, path: str) -> bool:
    """A table exists once its directory exists (it may hold no data file yet)."""
    recover(spark, path)
    return exists(spark, path)


def known_size(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a folder of its own under the checkpoint folder and read back.

    For a table with a row for each group that is to meet all rows: its size on storage is
    known when the plan is made, so the planner broadcasts it while it is small, without moving the
    rows, and takes a shuffled join beyond ``autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/metricslake-sides/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---- reading -----------------------------------------------------------------------


def read_lake_table(spark: SparkSession, path: str) -> DataFrame:
    recover(spark, path)
    return spark.read.parquet(path)


def read_by_statistics(spark: SparkSession, path: str) -> DataFrame:
    """The table through the reader that answers counts and extremes from the footers of the files."""
    key = "spark.sql.sources.useV1SourceList"
    recover(spark, path)
    usual = spark.conf.get(key)
    spark.conf.set(key, ",".join(s for s in usual.split(",") if s != "parquet"))
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(key, usual)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, merge_schema: bool = False) -> DataFrame:
    """The table, or an empty frame of ``schema`` when it does not exist yet or holds
    no data file (a partitioned write of zero rows leaves only the directory).

    ``merge_schema`` gives the columns of all files, not of one of them only.
    """
    if is_table(spark, path):
        try:
            return spark.read.option("mergeSchema", merge_schema).parquet(path)
        except AnalysisException as e:
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    return spark.createDataFrame([], schema)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Files holding a JSON array of objects (or JSON lines) -> rows.

    With a schema the types are fixed; without one Spark infers them from the data.
    """
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def require_non_empty(spark: SparkSession, path: str, name: str | None = None) -> None:
    """A table that exists must hold rows (an empty one means a broken earlier run)."""
    if is_table(spark, path) and read_or_empty(spark, path, T.StructType([])).isEmpty():
        raise ValueError(f"{name or path} exists without rows: an earlier run broke off")


# ---- writing -----------------------------------------------------------------------


def create_table_as(
    spark: SparkSession,
    path: str,
    df: DataFrame,
    or_replace: bool = False,
    if_not_exists: bool = False,
    with_no_data: bool = False,
) -> bool:
    """Create a table from a frame; returns whether anything was written.

    ``with_no_data`` keeps only the schema; ``if_not_exists`` leaves an existing
    table alone; ``or_replace`` replaces it (new directory, then swap).
    """
    if with_no_data:
        df = df.limit(0)
    if is_table(spark, path):
        if if_not_exists:
            return False
        if not or_replace:
            raise ValueError(f"table already exists: {path}")
        replace_table(spark, path, df)
        return True
    df.write.mode("errorifexists").parquet(path)
    return True


def create_typed_table(spark: SparkSession, path: str, schema: T.StructType) -> bool:
    """Create an empty table with a fixed schema if it does not exist."""
    return create_table_as(spark, path, spark.createDataFrame([], schema), if_not_exists=True)


def append_records(spark: SparkSession, path: str, df: DataFrame) -> None:
    """Append rows by column name (not position), cast to the table's types; partition columns stay."""
    target = spark.read.parquet(path).schema
    missing = [f.name for f in target if f.name not in df.columns]
    if missing:
        raise ValueError(f"batch lacks columns {missing} of {path}")
    rows = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in target])
    rows.write.mode("append").partitionBy(*partition_columns(spark, path)).parquet(path)


def replace_table(spark: SparkSession, path: str, df: DataFrame, partition_by: Iterable[str] = ()) -> None:
    """Write ``df`` to a new directory, then swap it in for ``path``.

    ``df`` may read ``path`` itself (upsert, compaction): it is fully written before
    the old directory is moved away. A stop at any step leaves the old or the new table: if it
    comes between the two renames, the next look at the table (:func:`recover`) moves the new
    directory in. What earlier stops have left beside the table is deleted at the end.
    """
    recover(spark, path)
    stale = [*_siblings(spark, path, "old"), *_siblings(spark, path, "new")]
    tag = uuid.uuid4().hex[:12]
    fresh, old = f"{path.rstrip('/')}.__new_{tag}", f"{path.rstrip('/')}.__old_{tag}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(fresh)
    if exists(spark, path):
        rename(spark, path, old)
    _moved(spark, fresh, path)
    for leftover in [old, *stale]:
        delete(spark, leftover)


def copy_tables(
    spark: SparkSession, src_root: str, dst_root: str, tables: Iterable[str]
) -> dict[str, str]:
    """Replace a full copy of each listed table; a missing table is reported and skipped."""
    status = {}
    for t in tables:
        src, dst = f"{src_root.rstrip('/')}/{t}", f"{dst_root.rstrip('/')}/{t}"
        if not is_table(spark, src):
            status[t] = "missing"
            continue
        replace_table(spark, dst, spark.read.parquet(src))
        status[t] = "copied"
    return status


def materialize_derived(
    spark: SparkSession,
    builders: dict[str, Callable[[], DataFrame]],
    dst_root: str,
    only: Iterable[str] | None = None,
) -> dict[str, str]:
    """Run named builders and store each result under its name; ``only`` picks a subset
    (an unknown name is an error)."""
    names = list(builders)
    if only is not None:
        only = list(only)
        unknown = sorted(set(only) - set(builders))
        if unknown:
            raise ValueError(f"unknown derived table(s): {', '.join(unknown)}")
        names = [n for n in names if n in only]
    status = {}
    for n in names:
        replace_table(spark, f"{dst_root.rstrip('/')}/{n}", builders[n]())
        status[n] = "materialized"
    return status


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """Columns that a table's directories are named by (``column=value``), outermost first."""
    columns: list[str] = []
    while True:
        fs, p = _fs(spark, "/".join([path.rstrip("/"), *["*"] * len(columns), "*=*"]))
        found = fs.globStatus(p) or ()
        name = next((s.getPath().getName().split("=")[0] for s in found if s.isDirectory()), None)
        if name is None:
            return columns
        columns.append(name)


def compact_table(
    spark: SparkSession, path: str, target_file_bytes: int = 128 * 1024 * 1024, order_by: Iterable[str] = ()
) -> int:
    """Rewrite a table into files of about ``target_file_bytes``; returns the intended file count.

    The file count comes from the table's size on storage. Partition columns stay: rows are
    brought together by them, and Spark splits a large partition over several tasks. A
    table with a declared order is range-partitioned and sorted by it, so its files keep
    tight statistics; any other is dealt round-robin (no key, so no skew).
    """
    recover(spark, path)
    n_files = max(1, math.ceil(total_bytes(spark, path) / target_file_bytes))
    df, parts, order = spark.read.parquet(path), partition_columns(spark, path), list(order_by)
    if parts:
        dealt = df.hint("rebalance", *parts)
        dealt = dealt.sortWithinPartitions(*parts, *order) if order else dealt
    elif order:
        dealt = df.repartitionByRange(n_files, *order).sortWithinPartitions(*order)
    else:
        dealt = df.repartition(n_files)
    replace_table(spark, path, dealt, parts)
    return n_files
