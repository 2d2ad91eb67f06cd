"""Change-only upserts, snapshot comparison and column statistics.

Parquet tables have no MERGE, so an upsert is expressed relationally:
``changed = batch EXCEPT target`` (distinct, NULL-safe), then
``target LEFT ANTI JOIN changed ON keys  UNION ALL  changed``; the EXCEPT only
looks at target rows whose key is in the batch. Writing is left to
``metricslake.sources.lake`` (new directory, then swap), and it is skipped when
nothing changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricslake.sources import lake

#: Types whose smallest and largest value the statistics of a file give exactly, and types without statistics.
WITH_EXTREMES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def _aligned(batch: DataFrame, target: DataFrame) -> DataFrame:
    """The batch with the target's columns, by name, in the target's order and types."""
    return batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.schema])


def changed_rows(batch: DataFrame, target: DataFrame) -> DataFrame:
    """Distinct rows of ``batch`` that are not in ``target`` (new or updated)."""
    return _aligned(batch, target).subtract(target)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once (an ambiguous merge source)."""
    return df.groupBy(*keys).count().where(F.col("count") > 1).select(*keys)


def upsert_changed(
    target: DataFrame, batch: DataFrame, keys: list[str], check_duplicates: bool = True
) -> DataFrame:
    """Target after merging the changed rows of ``batch``: matched keys are replaced,
    new keys inserted, untouched rows kept.

    With ``check_duplicates`` a changed key occurring twice makes the result fail when it
    is computed (the merge would be ambiguous); nothing runs while the plan is built.
    """
    # A batch row can only equal a target row with the same key, so the EXCEPT runs
    # against the target rows whose key is in the batch: with a small batch the key
    # list is broadcast and the stored table is filtered where it is read, never
    # shuffled whole.
    batch = _aligned(batch, target)
    bkeys = batch.select(*keys).distinct()
    on_keys = reduce(lambda a, b: a & b, [target[k].eqNullSafe(bkeys[k]) for k in keys])
    touched = target.join(bkeys, on_keys, "left_semi")
    changed = batch.subtract(touched)
    if check_duplicates:
        twice = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
        message = F.concat(F.lit("duplicate keys in upsert batch: "), F.to_json(F.struct(*keys)))
        checked = F.when(F.col("_twice"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
        changed = changed.withColumn("_twice", twice).where(checked).drop("_twice")
    on = reduce(lambda a, b: a & b, [target[k].eqNullSafe(changed[k]) for k in keys])
    kept = target.join(changed, on, "left_anti")
    return kept.unionByName(changed)


def upsert_high_water_mark(marks: DataFrame, new_marks: DataFrame) -> DataFrame:
    """Marks merged on ``repository_id`` (new value wins)."""
    return upsert_changed(
        marks, new_marks.select("repository_id", "max_run_id"), ["repository_id"]
    )


def snapshot_diff(before: DataFrame, after: DataFrame, order_by: str | None = "id") -> DataFrame:
    """New rows and after-images of updated rows: ``after EXCEPT before``.

    Deleted rows and before-images are absent. (A change log would also drop a row
    that changes and returns to an earlier value inside the range; a snapshot
    comparison shows the final value.)
    """
    out = _aligned(after, before).subtract(before)
    return out.orderBy(F.col(order_by).asc_nulls_last()) if order_by else out


def snapshot_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Changes by key with a kind: 'insert', 'update' (after-image) or 'delete' (before-image)."""
    cols = [c for c in after.columns if c not in keys]
    b = before.select(*keys, F.struct(*cols).alias("_b"))
    a = after.select(*keys, F.struct(*cols).alias("_a"))
    j = b.join(a, keys, "full_outer")
    kind = (
        F.when(F.col("_b").isNull(), F.lit("insert"))
        .when(F.col("_a").isNull(), F.lit("delete"))
        .when(~F.col("_a").eqNullSafe(F.col("_b")), F.lit("update"))
    )
    image = F.coalesce(F.col("_a"), F.col("_b"))
    return (
        j.withColumn("change_type", kind)
        .where(F.col("change_type").isNotNull())
        .select(*keys, "change_type", *[image[c].alias(c) for c in cols])
    )


def _is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def column_profile(
    df: DataFrame, columns: list[str] | None = None, cast_to: str = "string", null_counts: dict[str, int] | None = None
) -> DataFrame:
    """Per column: min, max (cast to ``cast_to``), whether it holds a NaN, NULL count.

    One aggregate job over all the columns (partial aggregation per task), then one
    row per column. ``null_counts`` holds those that are known already.
    """
    columns, known = columns or df.columns, null_counts or {}
    types = {f.name: f.dataType for f in df.schema}
    aggs: list[Column] = []
    for i, c in enumerate(columns):
        nan = F.bool_or(F.isnan(c)) if _is_floating(types[c]) else F.lit(False)
        aggs += [
            F.min(c).cast(cast_to).alias(f"_min{i}"),
            F.max(c).cast(cast_to).alias(f"_max{i}"),
            nan.alias(f"_nan{i}"),
            (F.lit(known[c]).cast("long") if c in known else F.count_if(F.col(c).isNull())).alias(f"_null{i}"),
        ]
    one = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"_min{i}").alias("min_value"),
                F.col(f"_max{i}").alias("max_value"),
                F.col(f"_nan{i}").alias("contains_nan"),
                F.col(f"_null{i}").alias("null_count"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return one.select(F.inline(rows))


def stored_profile(spark: SparkSession, path: str, columns: list[str] | None = None, cast_to: str = "string") -> DataFrame:
    """:func:`column_profile` of a stored table from the statistics of its files, as far as they tell.

    NULL counts come from the footers when this is called. Whole numbers and dates without a NULL have their
    extremes from there too; only the other columns (text, fractions, times, and those with NULLs, whose
    row groups may have no extremes) are read. Files without statistics are read as a whole.
    """
    table = lake.read_by_statistics(spark, path)
    columns, types = columns or table.columns, {f.name: f.dataType for f in table.schema}
    apart = set(lake.partition_columns(spark, path))  # not in the files
    flat = [c for c in columns if c not in apart and not isinstance(types[c], NESTED)]
    try:
        *filled, rows = table.agg(*[F.count(c) for c in flat], F.count(F.lit(1))).first()
    except PySparkException as e:
        if "aggregatePushdown" not in str(e):
            raise
        return column_profile(spark.read.parquet(path), columns, cast_to)
    # a table without row groups has no counts
    nulls = {c: (rows or 0) - (n or 0) for c, n in zip(flat, filled)}
    told = [c for c in flat if rows and not nulls[c] and isinstance(types[c], WITH_EXTREMES)]
    rest = [c for c in columns if c not in told]
    parts = [column_profile(table, told, cast_to, nulls)] if told else []
    parts += [column_profile(spark.read.parquet(path), rest, cast_to, nulls)] if rest else []
    return reduce(DataFrame.unionByName, parts)


def max_id(df: DataFrame, col: str = "id") -> DataFrame:
    return df.agg(F.max(col).alias("max_id"))
