"""Exact interpolated median per group that puts no hot group into one task.

One path for groups of any size, without a job while the plan is built:

1. rows become (group, value, count): ties collapse in the partial aggregate;
2. values are dealt into buckets by a monotone function of the value, finer than one part
   in four thousand, so a group has a bounded number of buckets whatever its size; running
   counts over them show in which bucket the middle ranks lie;
3. only the values of those buckets are ranked, behind the count of what comes before.

Every step depends on values alone, never on how rows are partitioned, so a plan that is
evaluated twice gives the same result. No rows are dropped or sampled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_E_FOLD = 4096
SMALLEST = 1e-9  # values closer to zero than this share a bucket with zero
LARGEST = 1e290  # values beyond this (and infinity) share a bucket
NAN_BUCKET = 1 << 40  # NaN sorts last


def _bucket(value: Column) -> Column:
    """Whole number that never falls as the value rises (the logarithm is monotone)."""
    size = F.log1p(F.least(F.abs(value), F.lit(LARGEST)) / F.lit(SMALLEST))
    place = F.floor(F.signum(value) * size * BUCKETS_PER_E_FOLD)
    return F.when(F.isnan(value), F.lit(NAN_BUCKET)).otherwise(place).cast("long")


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, ``_v``, ``_c``): how often each non-NULL value of a group occurs."""
    vals = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    return vals.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))


def median_of_counts(counted: DataFrame, keys: list[str], alias: str = "median") -> DataFrame:
    """Median of each group of :func:`value_counts`."""
    placed = counted.withColumn("_b", _bucket(F.col("_v")))
    group = Window.partitionBy(*keys)
    upto = Window.unboundedPreceding, Window.currentRow
    buckets = (
        placed.groupBy(*keys, "_b")
        .agg(F.sum("_c").alias("_in"))
        .withColumn("_to", F.sum("_in").over(group.orderBy("_b").rowsBetween(*upto)))
        .withColumn("_n", F.sum("_in").over(group))
    )
    # 1-based middle ranks; equal when the count is odd
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    before = F.col("_to") - F.col("_in")
    places = {k: f"_at{i}" for i, k in enumerate([*keys, "_b"])}
    middle = buckets.where((F.col("_to") >= low) & (before < high)).select(
        *[F.col(k).alias(at) for k, at in places.items()], before.alias("_before"), low.alias("_low"), high.alias("_high")
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(at)) for k, at in places.items()])
    near = placed.join(middle, same).drop(*places.values())
    by_value = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(*upto)
    ranked = near.withColumn("_to", F.col("_before") + F.sum("_c").over(by_value))
    at = lambda rank: F.max(F.when((F.col("_to") - F.col("_c") < rank) & (rank <= F.col("_to")), F.col("_v")))
    # same interpolation as the built-in: 0.5 * lower + 0.5 * upper
    return ranked.groupBy(*keys).agg(
        (F.lit(0.5) * at(F.col("_low")) + F.lit(0.5) * at(F.col("_high"))).alias(alias)
    )


def exact_median(df: DataFrame, keys: list[str], value: str, alias: str = "median") -> DataFrame:
    """``groupBy(keys).agg(median(value))`` that stays exact and skew-safe.

    NULL values are ignored; a group with no non-NULL value yields no row (callers
    left-join the result, which gives the NULL a SQL median returns).
    """
    return median_of_counts(value_counts(df, keys, value), keys, alias)
