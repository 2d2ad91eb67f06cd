"""The pipeline against a plain version of every stage, and odd inputs."""

import hashlib
import struct

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from metricslake.llm import langid, mixing, pii
from metricslake.llm.registry import MIX_FRACTION, MIX_SEED, MIX_WEIGHTS
from plain import brute_components, waterfill_tree

SF = "/root/testdata/sf0.001"


def plain_mix(docs):
    """Ids that the mix takes, by water-filling with whole tokens and one pass over each leaf."""
    leaves = {}
    for d in docs:
        digits = "".join(c for c in (d["source"] or "") if c.isdigit())
        key = (f"domain{int(digits) % 4 if digits else 0}", d["lang"] or "(none)", d["source"] or "(none)")
        n = len((d["text"] or "").split())
        if n:
            leaves.setdefault(key, []).append((d["doc_id"], n))
    supply = {k: sum(n for _, n in v) for k, v in leaves.items()}
    shares = waterfill_tree(supply, sum(supply.values()) * MIX_FRACTION[0] // MIX_FRACTION[1], [MIX_WEIGHTS["domain"], MIX_WEIGHTS["lang"], {}])
    taken = set()
    for key, rows in leaves.items():
        left = shares[key]
        if left == supply[key]:
            taken |= {d for d, _ in rows}
            continue
        place = lambda d: int(hashlib.md5(f"{MIX_SEED}:1:{d}".encode()).hexdigest()[:15], 16)
        for d, n in sorted(rows, key=lambda r: (place(r[0]), r[1])):
            if left <= 0:
                break
            taken.add(d)
            left -= n
    return taken


def test_pipeline_against_plain_stages(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [r.asDict() for r in documents.collect()]
    models = langid.Models(langid.fit(documents))
    docs = [d for d in docs if not models.predict([d["text"]])[2][0]]
    component = brute_components([(d["doc_id"], d["text"]) for d in docs], 5, 80, 100)
    docs = [d for d in docs if component[d["doc_id"]] == d["doc_id"]]
    for d in docs:
        d["text"] = pii.redact(d["text"])
    taken = plain_mix(docs)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for d in docs:
        if d["doc_id"] in taken:
            ids = tokenizer.encode(d["text"], add_special_tokens=False).ids
            packed = struct.pack(f"<{len(ids)}I", *ids)
            want[d["doc_id"]] = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_keep_columns_and_take_odd_rows(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    first = documents.limit(30)
    odd = spark.createDataFrame(
        [(None, "a text without an id", None, None, None), (5000, None, "en", "src1", 0), (5001, "", "en", None, 0), (5002, "the thing " * 9000, None, "src1", 9)],
        documents.schema,
    )
    for docs in (first.union(odd).union(odd).withColumn("rejected", F.lit("x")).withColumn("keys", F.lit(1)), documents.limit(0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            assert name == "tokens" or docs.columns == columns
            docs.collect()


def test_every_clean_document_is_kept_by_language_id(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.language_id(spark, documents, "").count()
    assert kept >= 0.995 * documents.count()
    assert mixing.NO_VALUE == "(none)"
