"""Operator 11 against a plain version, on odd rows and longer n-grams."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from metricslake.llm import resample
from metricslake.llm.common import prepare

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text, low, high):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]


def plain(rows, target, share, seed, low=1, high=1, least=20, buckets=10_000):
    s, t = [0] * buckets, [0] * buckets
    for texts, total in ((x for _, x in rows), s), (target, t):
        for text in texts:
            for f in features(text, low, high):
                total[zlib.crc32(f.encode()) % buckets] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (big_s + buckets) / ((a + 1) * (big_t + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        found = features(text, low, high)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, len(words(text)) >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: share[0] * len(able) // share[1]])}
    return sorted([(*r[:4], drawn.get(id(r))) for r in out], key=repr)


def rows_of(frame):
    return sorted([(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in frame.collect()], key=repr)


TARGET = ["Alpha beta gamma delta", "alpha beta alpha ÉTÉ", None, ""]
TEXTS = [
    "alpha BETA gamma " * 9, "été--ÉTÉ x1 alpha " * 8, "zeta eta theta " * 30, None, "", " .,;", "alpha", "one two " * 11,
    "beta\x00gamma\ttab\x7fend " * 6, "日本 語 alpha " * 7, "delta " * 5000,
]


@pytest.mark.parametrize("low, high", [(1, 1), (1, 3), (2, 2)])
def test_against_plain(spark, low, high):
    prepare(spark)
    rows = [(k * 7 % 41, TEXTS[k % len(TEXTS)]) for k in range(41)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    found = resample.resample(docs, target, (3, 10), 5, low, high)
    assert rows_of(found) == plain(rows, TARGET, (3, 10), 5, low, high)


def test_ranges_of_the_order(spark):
    """Ranks over many sorted ranges, with ties of the score."""
    rows = spark.range(5000).selectExpr("id as doc_id", "id % 7 as score").repartition(9)
    found = resample.ranked(rows, [rows["score"].desc(), rows["doc_id"].asc()], "order").collect()
    expected = sorted(((-(k % 7), k) for k in range(5000)))
    assert sorted((r["rank"], r.doc_id) for r in found) == [(k + 1, i) for k, (_, i) in enumerate(expected)]


def test_odd_rows(spark):
    """Null and repeated ids, clashing names, empty tables; whole documents of a draw."""
    long_text = "alpha beta " * 20
    rows = [(None, long_text, "a", 1), (None, long_text, "a", 1), (3, long_text, "b", 2), (3, long_text, "b", 2), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank string, score int")
    target = spark.createDataFrame([("alpha",)], "text string")
    found = rows_of(resample.resample(docs, target, (1, 1), 9))
    assert found == plain([r[:2] for r in rows], ["alpha"], (1, 1), 9)
    assert sorted(r[4] for r in found if r[4]) == [1, 2, 3, 4]
    ranks = resample.resample(docs, target, (1, 2), 9)
    assert {r["rank"] for r in resample.drawn_documents(docs, ranks).collect()} <= {"b"}
    assert resample.resample(docs.limit(0), target, (1, 2), 9).collect() == []
    none = rows_of(resample.resample(docs, target.limit(0), (0, 1), 9))
    assert none == plain([r[:2] for r in rows], [], (0, 1), 9)


def test_slices_do_not_change_counts(monkeypatch):
    texts = pa.array(["alpha beta " * k for k in range(40)] + [None, ""])
    whole = np.bincount(resample.grams(texts, 1, 2).bucket, minlength=10_000)
    monkeypatch.setattr(resample, "SLICE_BYTES", 500)
    parts = list(resample.slices(texts))
    assert len(parts) > 5 and sum(map(len, parts)) == len(texts)
    assert (sum(np.bincount(resample.grams(p, 1, 2).bucket, minlength=10_000) for p in parts) == whole).all()
