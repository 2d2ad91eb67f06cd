"""Operator 9 against a plain pass over all strings."""

import hashlib
import random

import numpy as np
import pytest

from metricslake.llm import repeats
from metricslake.llm.registry import op9_repeats

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, kept string, _doc int"


def plain(rows):
    seen, out = {}, {}
    data = {i: (t or "").encode() for i, t in rows}
    for i in sorted(data, key=lambda i: (i is None, i or 0)):
        d, mark = data[i], bytearray(len(data[i]))
        for s in range(len(d) - 99):
            g = d[s : s + 100]
            if g in seen:
                mark[s : s + 100] = b"\1" * 100
            else:
                seen[g] = (i, s)
        kept = bytes(b for b, m in zip(d, mark) if not m)
        spans = sum(1 for k, m in enumerate(mark) if m and not (k and mark[k - 1]))
        out[i] = (len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_query(spark):
    rows = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(op9_repeats(spark, SF)) == plain(rows)


@pytest.mark.parametrize("chunk, segment, batch", [(512, 1 << 21, 4096), (3, 500, 20)])
def test_random_texts(spark, monkeypatch, chunk, segment, batch):
    for name, value in (("CHUNK_RUNS", chunk), ("SEGMENT_BYTES", segment), ("BATCH_RUNS", batch)):
        monkeypatch.setattr(repeats, name, value)
    rng = random.Random(9)
    line = "".join(rng.choice("abcdef é") for _ in range(230))
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = []
    for i in range(60):
        a = rng.randrange(0, 130)
        rows.append((200 - i, word(rng.randrange(150)) + line[a : a + rng.randrange(90, 230)] * rng.randrange(3) + word(rng.randrange(300))))
    rows += [(300, "x" * 700), (301, "x" * 100), (302, "x" * 99), (303, None), (304, ""), (305, "ab" * 400), (306, line), (307, line), (None, line + word(50))]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], SCHEMA)
    assert got(repeats.digests(repeats.without_repeats(df))) == plain(rows)


def test_repeated_rows_and_empty_tables(spark):
    text = "".join(chr(97 + k * k % 26) for k in range(50)) * 5
    df = spark.createDataFrame([(1, text, "k", 1), (1, text, "k", 1), (2, text, "k", 1)], SCHEMA)
    rows = repeats.without_repeats(df).collect()
    once = plain([(1, text)])[1]
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, once[1]), (1, once[1]), (2, len(text))]
    assert repeats.without_repeats(df.limit(0)).collect() == []


def test_texts_without_an_id_of_their_own(spark):
    """A repeat in one text takes nothing from another that lacks an id or shares one."""
    rng = random.Random(3)
    clean, part = ("".join(rng.choice("abcdefghij") for _ in range(500)) for _ in range(2))
    other = "".join(rng.choice("klmnop") for _ in range(300))
    df = spark.createDataFrame([(1, part, "k", 1), (None, clean, "k", 1), (None, other + part[100:250], "k", 1), (5, clean[:90], "k", 1), (5, other[:90] + part[:150], "k", 1)], SCHEMA)
    rows = sorted((r.n_bytes, r.n_removed) for r in repeats.without_repeats(df).collect())
    assert rows == [(90, 0), (240, 150), (450, 150), (500, 0), (500, 0)]


def test_runs_cover_all_strings_and_depend_on_their_bytes():
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 101, n).astype(np.uint8).tobytes() for n in (99, 100, 101, 1000, 0)]
    shared = texts[3][200:420]
    texts.append(b"zz" + shared + b"yy")
    keys, places = repeats.runs(texts)
    for t, k, p in zip(texts, keys, places):
        starts = [s for x in p for s in range(x // repeats.RUN, x // repeats.RUN + x % repeats.RUN + 1)]
        assert starts == list(range(max(0, len(t) - 99)))
    of = lambda n, s: next(k for k, x in zip(keys[n], places[n]) if x // repeats.RUN <= s <= x // repeats.RUN + x % repeats.RUN)
    assert all(of(3, 200 + s) == of(5, 2 + s) for s in range(len(shared) - 99))


@pytest.mark.parametrize("letters, n, width", [(1, 40, 5), (2, 300, 8), (3, 257, 6), (26, 100, 4), (2, 1, 3), (2, 2, 3)])
def test_longest_previous_factors(letters, n, width):
    """Against all pairs, some positions being those of repeated rows."""
    rng = np.random.default_rng(letters * n)
    rows = rng.integers(97, 97 + letters, (n, width)).astype(np.uint8)
    position = np.sort(rng.integers(0, n, n)) if n > 2 else np.arange(n)
    share = lambda a, b: next((k for k in range(width) if a[k] != b[k]), width)
    want = [max((share(rows[i], rows[j]) for j in range(n) if position[j] < position[i]), default=0) for i in range(n)]
    order = rng.permutation(n)  # equal suffixes may stand in any order
    order = order[np.argsort(np.ascontiguousarray(rows[order]).view(f"V{width}").ravel(), kind="stable")]
    assert repeats.previous_factors(rows[order], position[order]).tolist() == [want[i] for i in order]
    assert repeats.previous_factors(rows[:0], position[:0]).tolist() == []
