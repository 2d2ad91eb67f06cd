"""The corpus pipeline: language ID, near duplicates, personal data, mix, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All stages but the last keep the
columns of ``documents``.

Rows without an id stay through the filters that need one; of rows that repeat an id and its
text one stays when near duplicates go. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricslake.llm import bpe, langid, mixing, ngram_join, pii
from metricslake.llm.common import prepare, written
from metricslake.llm.registry import MIX_FRACTION, MIX_SEED, MIX_WEIGHTS, mix_levels, word_bpe
from metricslake.sources.tables import read_table

#: Near duplicates: shingles of five words, Jaccard similarity of 0.8 or more.
SHINGLE_WORDS = 5
SIMILARITY = ngram_join.Threshold(80, 100)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the labelled rows teach; a missing label is filled in."""
    prepare(spark)
    found = langid.predict(docs, langid.fit(docs)).filter(~F.col("rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Only rows whose id occurs more than once are moved to drop copies of them; the two tables of ids
    are in the shared folder, so the joins know their sizes.
    """
    prepare(spark)
    joined = ngram_join.join(docs, SHINGLE_WORDS, SIMILARITY)
    later = written(joined.filter("doc_id <> component_id").select("doc_id").distinct(), "later")
    again = written(joined.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    kept = docs.join(later, "doc_id", "left_anti")
    single = kept.join(again, "doc_id", "left_anti").select(*docs.columns)
    copies = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return single.union(copies)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind."""
    prepare(spark)
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that one epoch of the mix of domains, languages and sources takes."""
    prepare(spark)
    return mixing.mixed(docs, mix_levels(), MIX_WEIGHTS, MIX_FRACTION, MIX_SEED)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of ids and decoded text."""
    prepare(spark)
    coded = bpe.encode(docs, word_bpe())
    return coded.select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: Language models and merges are not expressible in SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
