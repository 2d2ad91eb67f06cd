"""Reading the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEST_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# One relation per (session, path): a DataFrame is immutable and lazy, so reusing it
# only saves the file listing and the footer read that infer the schema again.
_relations: dict[tuple[str, int, str], DataFrame] = {}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; Catalyst prunes columns and pushes filters into the scan."""
    path = table_path(sf_dir, name)
    key = (spark.sparkContext.applicationId, id(spark), path)
    df = _relations.get(key)
    if df is None:
        df = spark.read.parquet(path)
        _relations[key] = df
    return df
