"""Connected components of an edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricslake.llm.common import drop_written, written


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Hang neighbours on the smallest node around: of each node its larger neighbours (large
    star), or the node and its smaller neighbours (small star)."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    if small:
        hung = near.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        hung = hung.union(least.select(F.col("u"), F.col("m")))
    else:
        least = least.select("u", F.least("u", "m").alias("m"))
        hung = near.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return hung.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node it reaches) for each node with an edge.

    ``edges`` has whole numbers ``a`` and ``b``. Each round is written to the shared folder;
    rounds grow with the logarithm of the longest path. Only the number of edges and a sum
    over them reach the driver, to see whether a round has changed anything.
    """
    edges = written(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        last, edges = edges, written(_stars(_stars(edges, small=False), small=True), "edges")
        drop_written(edges.sparkSession, last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b"), F.col("b")).distinct()
            )
        seen = now
