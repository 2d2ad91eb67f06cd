"""An append-only log of a table's changes, with images before and after.

Each snapshot of a table that is stored adds the changes since the one before, as rows with
the table's columns, ``change_type`` and ``snapshot``:

    insert             the new row
    update_preimage    the row as it was
    update_postimage   the row as it is now
    delete             the row that went

A snapshot's rows are a partition of their own, written with dynamic overwrite, so recording
a snapshot again adds nothing, and a range of snapshots is read by partition pruning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricslake.sources import lake

TYPE_COL, SNAPSHOT_COL = "change_type", "snapshot"
NEW, GONE = ("insert", "update_postimage"), ("update_preimage", "delete")


def change_images(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of ``after`` and ``change_type``: one row for an inserted or deleted key, two for an updated one.

    Keys are unique in both; null keys are equal to each other. Columns that ``before`` lacks are null there.
    """
    for f in after.schema:
        if f.name not in before.columns:
            before = before.withColumn(f.name, F.lit(None).cast(f.dataType))
    columns = after.columns
    b = before.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], F.struct(*columns).alias("_before"))
    a = after.select(*[F.col(k).alias(f"_a{i}") for i, k in enumerate(keys)], F.struct(*columns).alias("_after"))
    same = F.lit(True)
    for i in range(len(keys)):
        same &= F.col(f"_b{i}").eqNullSafe(F.col(f"_a{i}"))
    met = b.join(a, same, "full_outer").where(~F.col("_before").eqNullSafe(F.col("_after")))
    updated = F.col("_before").isNotNull() & F.col("_after").isNotNull()
    images = F.filter(
        F.array(
            F.struct(F.when(updated, GONE[0]).otherwise(GONE[1]).alias("kind"), F.col("_before").alias("image")),
            F.struct(F.when(updated, NEW[1]).otherwise(NEW[0]).alias("kind"), F.col("_after").alias("image")),
        ),
        lambda x: x["image"].isNotNull(),
    )
    return met.select(F.explode(images).alias("_x")).select("_x.image.*", F.col("_x.kind").alias(TYPE_COL))


def record(spark: SparkSession, path: str, before: DataFrame, after: DataFrame, keys: list[str], snapshot: int) -> None:
    """Add the changes from ``before`` to ``after`` to the log as those of ``snapshot``."""
    rows = change_images(before, after, keys).withColumn(SNAPSHOT_COL, F.lit(snapshot).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SNAPSHOT_COL).parquet(path)


def read(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The changes of the snapshots ``first`` to ``last``; columns that came later are null before."""
    log = lake.read_or_empty(spark, path, lake.T.StructType(), merge_schema=True)
    return log.where(F.col(SNAPSHOT_COL).between(first, last))


def new_values(log: DataFrame, order_by: str | None = "id") -> DataFrame:
    """The distinct rows that a range of changes brought and did not take away again.

    Inserted rows and images after an update, less images before an update and deleted rows. A row that
    passes through a value and returns to it inside the range is absent, which two snapshots cannot tell.
    """
    columns = [c for c in log.columns if c not in (TYPE_COL, SNAPSHOT_COL)]
    # one aggregate instead of set operations: a value stays unless some change took it away
    kept = log.groupBy(*columns).agg(F.bool_or(F.col(TYPE_COL).isin(*GONE)).alias("_gone")).where(~F.col("_gone")).select(*columns)
    return kept.orderBy(F.col(order_by).asc_nulls_last()) if order_by else kept


def net_changes(log: DataFrame, keys: list[str]) -> DataFrame:
    """What a range of changes comes to for each key: the first image before against the last one after.

    ``change_type`` is ``insert``, ``update`` or ``delete``, the columns those of the image after (before, for a
    delete). Keys that end as they began, or come and go inside the range, are absent.
    """
    columns = [c for c in log.columns if c not in (TYPE_COL, SNAPSHOT_COL)]
    new = F.col(TYPE_COL).isin(*NEW)
    # within a snapshot the image before comes first; one row for each key and place
    place = F.col(SNAPSHOT_COL) * 2 + new.cast("long")
    rows = log.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], place.alias("_place"), new.alias("_new"), F.struct(*columns).alias("_image"))
    own = [f"_k{i}" for i in range(len(keys))]
    ends = rows.groupBy(*own).agg(F.min("_place").alias("_lo"), F.max("_place").alias("_hi"))

    def at(end: str, name: str) -> DataFrame:
        """The image at one end of each key's changes, null if there is no row there."""
        told = ends.select(*[F.col(k).alias(f"{name}{k}") for k in own], F.col(end).alias(f"_at_{name}"))
        same = F.col("_place") == F.col(f"_at_{name}")
        for k in own:
            same &= F.col(k).eqNullSafe(F.col(f"{name}{k}"))
        image = F.when(F.col("_new") == (name == "last"), F.col("_image"))
        return rows.join(told, same).select(*[F.col(f"{name}{k}") for k in own], image.alias(f"_{name}"))

    same = F.lit(True)
    for k in own:
        same &= F.col(f"first{k}").eqNullSafe(F.col(f"last{k}"))
    before, after = F.col("_first"), F.col("_last")
    kind = F.when(before.isNull() & after.isNull(), None).when(before.isNull(), "insert").when(after.isNull(), "delete")
    kind = kind.when(~before.eqNullSafe(after), "update")
    met = at("_lo", "first").join(at("_hi", "last"), same)
    told = met.select(kind.alias(TYPE_COL), F.coalesce(after, before).alias("_image")).where(F.col(TYPE_COL).isNotNull())
    return told.select("_image.*", TYPE_COL)
