"""The operators of this subpackage as queries over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricslake.llm import ann, article, bpe, exact_topk, infill, langid, license_scan, mixing, ngram_join, pii, repeats, resample, warc
from metricslake.llm.common import prepare
from metricslake.sources.tables import read_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(prepare(spark), sf_dir, name)


def word_bpe() -> str:
    """Place of the tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"), 3, ngram_join.Threshold(90, 100))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    return ann.nearest(table, exact_topk.query_rows(), ann.fit(table))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.detect(_table(spark, sf_dir, "documents")))


def mix_levels() -> dict[str, Column]:
    """Levels of the mix; domains are groups of sources, by the number that ends a source's name."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]{1,9})$", 1).try_cast("bigint") % 4, F.lit(0))
    return {"domain": F.concat(F.lit("domain"), number.cast("string")), "lang": F.col("lang"), "source": F.col("source")}


MIX_LEVELS_SQL = {
    "domain": "'domain' || coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) as bigint) % 4, 0)",
    "lang": "lang",
    "source": "source",
}
MIX_WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2}, "lang": {"en": 5, "de": 2, "fr": 2}}
#: Share of all tokens in the mix, passes over a source, seed of the order.
MIX_FRACTION, MIX_EPOCHS, MIX_SEED = (3, 5), 2, 17


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(_table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, MIX_FRACTION, MIX_EPOCHS, MIX_SEED)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(_table(spark, sf_dir, "embeddings"), exact_topk.query_rows())


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digests(license_scan.scan(_table(spark, sf_dir, "documents")))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select(
        "doc_id", langid.is_held_out("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "rejected"
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read(warc.write(_table(spark, sf_dir, "pages")), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.without_repeats(_table(spark, sf_dir, "documents")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(_table(spark, sf_dir, "documents"), word_bpe()))


#: Share of the long enough documents to draw, seed of the draw.
DRAW_SHARE, DRAW_SEED = (10, 100), 2024


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    found = resample.resample(docs, target, DRAW_SHARE, DRAW_SEED)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article.extract(_table(spark, sf_dir, "pages"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.restored(infill.rewritten(_table(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_ann": op2_ann,
    "op3_pii": op3_pii,
    "op4_mixing": op4_mixing,
    "op5_topk": op5_topk,
    "op6_license": op6_license,
    "op7_langid": op7_langid,
    "op8_warc": op8_warc,
    "op9_repeats": op9_repeats,
    "op10_bpe": op10_bpe,
    "op11_resample": op11_resample,
    "op12_article": op12_article,
    "op13_infill": op13_infill,
}

ORACLES = {
    "op4_mixing": mixing.oracle(MIX_LEVELS_SQL, MIX_WEIGHTS, MIX_FRACTION, MIX_EPOCHS, MIX_SEED),
    "op5_topk": exact_topk.oracle(),
    "op6_license": license_scan.oracle(),
    "op8_warc": warc.oracle(),
    "op11_resample": resample.oracle(DRAW_SHARE, DRAW_SEED),
    "op13_infill": infill.oracle(),
}
