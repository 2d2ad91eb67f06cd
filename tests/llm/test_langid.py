"""Operator 7: the model against a direct computation, held-out accuracy, rejection."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from metricslake.llm import langid
from metricslake.llm.registry import op7_langid

SF = "/root/testdata/sf0.01"


def plain_symbols(text):
    out = " "
    for c in text or "":
        c = c.lower()[0] if c.isalpha() else " "
        if c != " " or out[-1] != " ":
            out += c
    return out


def test_symbols_against_plain():
    texts = ["Hello,  World!", "", None, "  a", "é1É ß", "!!", "x\n", "Ünï—code 中文"]
    symbol, starts, letters = langid.symbols(texts)
    ends = [*starts[1:], len(symbol)]
    assert ["".join(map(chr, symbol[a:b])) for a, b in zip(starts, ends)] == [plain_symbols(t) for t in texts]
    assert letters.tolist() == [sum(c.isalpha() for c in t or "") for t in texts]


def plain_model(texts):
    """Interpolated Kneser-Ney with dictionaries."""
    order = langid.ORDER
    counts = {order: Counter()}
    for t in texts:
        s = " " * (order - 1) + plain_symbols(t)
        counts[order].update(s[i : i + order] for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount, total, kinds = {}, defaultdict(float), defaultdict(int)
    for k, c in counts.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[k] = min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2)))
        for g, v in c.items():
            total[k, g[:-1]] += v
            kinds[k, g[:-1]] += 1

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / langid.SYMBOLS
        h = (k, g[:-1])
        if h not in total:
            return p(g[1:])
        return (max(counts[k][g] - discount[k], 0) + discount[k] * kinds[h] * p(g[1:])) / total[h]

    return p


def test_model_against_plain():
    texts = ["the cat sat on the mat", "a cat and a rat", "that is the hat"]
    model, p = langid.Model(*langid.symbols(texts)[:2]), plain_model(texts)
    probe = ["the rat zat", "xyz", "on a mat", "é"]
    symbol, starts, _ = langid.symbols(probe)
    got = model.of(langid.ngrams(symbol, starts, langid.ORDER), langid.ORDER)
    want = []
    for t in probe:
        s = " " * (langid.ORDER - 1) + plain_symbols(t)
        want += [p(s[i : i + langid.ORDER]) for i in range(len(s) - langid.ORDER + 1)]
    assert np.allclose(got, want)


def test_merged_models_score_like_each_model():
    import pandas as pd

    samples = {"aa": ["the cat sat on the mat"] * 3 + ["one two three"] * 5, "bb": ["le chat est sur la table"] * 8}
    saved = [(k, langid.train(pd.DataFrame({"lang": k, "text": v, "pick": range(len(v))}))["model"][0]) for k, v in samples.items()]
    models = langid.Models(saved)
    bits, size, _ = models.entropy(["le chat", "the mat zq", ""])
    for k, (_, s) in enumerate(saved):
        one, _ = langid.loaded(s)
        symbol, starts, _ = langid.symbols(["le chat", "the mat zq", ""])
        each = -np.log2(one.of(langid.ngrams(symbol, starts, langid.ORDER), langid.ORDER))
        assert np.allclose(np.add.reduceat(each, starts) / size, bits[:, k], rtol=1e-4)
    assert models.predict(["le chat est la", "the cat sat", "12"])[0] == ["bb", "aa", "und"]


@pytest.fixture(scope="module")
def found(spark):
    return op7_langid(spark, SF).collect()


def test_held_out_accuracy(spark, found):
    docs = {d.doc_id: d for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(found) == len(docs)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)
    assert sum(r.rejected for r in found) <= 0.005 * len(found)


def test_rejects_what_is_no_language(spark):
    models = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    assert all(len(m) < 50e6 for _, m in models)
    rng = np.random.default_rng(1)
    noise = ["".join(chr(97 + x) for x in rng.integers(0, 26, 400)) for _ in range(20)] + ["中文字" * 50, "QkZGxx9/sk==" * 40]
    rows = [(k, t, "z", 1) for k, t in enumerate(noise)] + [(90, None, "z", 1), (91, "", "z", 1), (92, "12 !", "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, rejected int")
    got = langid.predict(df, models).collect()
    assert all(r.rejected for r in got) and {r.lang_pred for r in got if r.doc_id >= 90} == {"und"}
    assert langid.predict(df.limit(0), models).collect() == []


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(None, "text", "en"), (1, None, "en"), (2, "words", None)], "doc_id long, text string, lang string")
    assert langid.fit(df) == []
    assert {r.lang_pred for r in langid.predict(df, []).collect()} == {"und"}
    assert math.isclose(langid.predict(df, []).collect()[0].lang_score, 0)
