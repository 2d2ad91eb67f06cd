"""Operator 10 against the public library, and its round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from metricslake.llm import bpe
from metricslake.llm.registry import op10_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"

ODD = [
    None, "", " ", "\n\t", "a", "aaaaaaaaaaaaaaaaa", "Hello wörld's <|endoftext|> 123 \x1c x!!", "<|startoftext|><|endoftext|>x",
    "DON'T can't we'LL", "ﬁ Å Ⅷ ²³ 中文字 日本 émigré é ΑΣ ς Σ", "İstanbul ß ẞ", "🙂🙃 àb", "x" * 5000, "ab" * 3000,
    "a\x85b\xa0c d​e", "…!!??--__", "١٢٣ १२३", "\x00\x01\x7f", "the  the   the",
]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(open(PATH, encoding="utf-8").read())


def expected(lib, text):
    ids = lib.encode(text or "", add_special_tokens=False).ids
    return len(ids), np.array(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False)


def test_odd_texts(lib, own):
    for text in ODD:
        assert own.encode(text) == expected(lib, text), text


def test_random_texts(lib, own):
    rng = random.Random(1)
    for _ in range(400):
        letters = rng.choice(["abcdehlnost '", "ab", "thein rsaéüñ.,", "0a1 b!?'s", "aeiouçßÀ中 \n"])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert own.encode(text) == expected(lib, text), text


def test_only_one_path_for_each_word():
    """The automaton against merges applied one by one, on a small vocabulary with repeats."""
    merges = [("a", "a"), ("b", "a"), ("aa", "b"), ("a", "b"), ("aa", "aa"), ("ba", "ba"), ("ab", "ab")]
    vocab = {"a": 0, "b": 1} | {a + b: k + 2 for k, (a, b) in enumerate(merges)}
    automaton = bpe.Automaton(vocab, merges)
    rng = random.Random(2)
    for _ in range(2000):
        word = [rng.choice("ab") for _ in range(rng.randrange(1, 14))]
        tokens = list(word)
        for a, b in merges:
            out = []
            for t in tokens:
                if out and out[-1] == a and t == b and not (a == b and out[-1] is None):
                    out[-1] = (a + b,)
                else:
                    out.append(t)
            tokens = [t[0] if isinstance(t, tuple) else t for t in out]
        assert [automaton.labels[i] for i in automaton.encode(word)] == tokens


def test_query_and_decode(spark, lib):
    rows = {r.doc_id: r for r in op10_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        n, ids, text = expected(lib, d.text)
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_frames(spark):
    df = spark.createDataFrame([(1, "Hi there", "x"), (None, None, "y"), (1, "Hi there", "z")], "doc_id long, text string, ids string")
    coded = bpe.encode(df, PATH)
    rows = coded.collect()
    assert sorted(r.n_tokens for r in rows) == [0, 2, 2]
    assert {r.decoded for r in bpe.decode(coded, PATH).collect()} == {"hi</w> there</w>", ""}
    assert bpe.encode(df.limit(0), PATH).collect() == []


def test_long_words(lib, own):
    for text in ("abcdefgh" * 20_000, "a" * 4001, "the" * 3000 + "é" * 500):
        assert own.encode(text) == expected(lib, text)


def test_tokens_that_never_arise():
    """After ba has been merged, a is never followed by ba's letters: abab is in no tokenization."""
    merges = [("b", "a"), ("a", "b"), ("ab", "ab")]
    automaton = bpe.Automaton({"a": 0, "b": 1, "ba": 2, "ab": 3, "abab": 4}, merges)
    assert [automaton.labels[i] for i in automaton.encode(list("abab"))] == ["a", "ba", "b"]
