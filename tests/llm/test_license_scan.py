"""Operator 6 against a plain scan, and odd inputs."""

import re

from pyspark.sql import functions as F

from metricslake.llm import license_scan as ls
from metricslake.llm.registry import op6_license

SF = "/root/testdata/sf0.001"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def plain(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        got = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += got
        labels |= {label} if got else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(rows, texts):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id]), r
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 1.0) >= bool(r.labels)


def test_query(spark):
    texts = {d.doc_id: d.text for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op6_license(spark, SF).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_odd_texts(spark):
    texts = dict(enumerate([
        None, "", " .,", "MIT License", "mit  LICENSE mit license", "MITLicense", "licenſe mit", "MİT License", "CC-BY cc by cc", "GNU General Public",
        "gnu general public license " * 3000, "Apache License", "apache—license", "the Kelvin cc BY", "Licensed under the Apache License, Version 2.0.",
        "Permission is hereby granted, free of charge", "Permission is hereby granted, free of charge ... WITHOUT WARRANTY OF ANY KIND",
        "by cc", "license mit", "cc", "mit license cc by apache license gnu general public license",
    ]))
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in texts.items()], "doc_id long, text string, words string, places int")
    rows = ls.digests(ls.scan(df)).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[15] == "" and labels[16] == "mit"
    assert ls.scan(df.limit(0)).collect() == []
    again = ls.digests(ls.scan(df.union(df).withColumn("doc_id", F.lit(None).cast("long")))).collect()
    assert len(again) == 2 * len(texts)


def test_main_path_has_no_python(spark):
    plan = op6_license(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_licence_texts(spark):
    """Whole texts with a name, a changed word or a missing sentence; parts of them; texts in long files."""
    def body(k):
        return ls.TEMPLATES[k].passages

    texts = [k for k, t in enumerate(ls.TEMPLATES) if t.enough < 1]
    files = {k: "Copyright (c) 2024 Someone\n" + "\nSomeone ".join(body(k)) for k in texts}
    mit = next(k for k in texts if ls.TEMPLATES[k].label == "mit")
    files[100] = "word " * 30_000 + files[mit].replace("substantial", "large") + " word" * 30_000
    files[101] = " ".join(body(mit)[:1])  # one sentence of four: a share, and the phrase's label only with its key
    files[102] = files[mit].replace("restriction", "limits")  # the key phrase is gone
    files[103] = "of the and to in this license software " * 500
    files[104] = " ".join(reversed(files[mit].split()))
    df = spark.createDataFrame(list(files.items()), "doc_id long, text string")
    # other files, so that licence words are rare
    others = spark.range(1000, 4000).selectExpr("id as doc_id", "concat('some prose of file ', id, ' and the rest') as text")
    rows = {r.doc_id: r for r in ls.digests(ls.scan(df.union(others))).collect()}
    assert len(rows) == len(files) + 3000
    for k in texts:
        assert ls.TEMPLATES[k].label in rows[k].labels.split(","), (k, rows[k])
    assert "mit" in rows[100].labels.split(",") and rows[100].n_words == len(ls.split(files[100]))
    assert rows[101].labels == "" and 0.1 < rows[101].score < 0.9
    assert rows[102].labels == "mit"  # by the phrase and its key phrase, which are still there
    assert rows[103].labels == "" and rows[104].labels == ""
    assert all(rows[k].labels == "" for k in rows if k >= 1000)


def test_places_equal_a_plain_scan(spark):
    """Every whole passage of one part is found, however common its words are in the corpus."""
    import random

    rnd = random.Random(6)
    short = [t for t in ls.TEMPLATES if len(t.parts) == 1]
    vocabulary = sorted({w for t in short for w in t.parts[0]})
    texts = {k: " ".join(rnd.choices(vocabulary, k=rnd.randrange(400))) for k in range(150)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in ls.scan(df).collect():
        words = ls.split(texts[r.doc_id])
        for k, t in enumerate(ls.TEMPLATES):
            p = t.parts[0]
            want = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p] if t in short else []
            assert r.places[k] == want, (r.doc_id, t)
