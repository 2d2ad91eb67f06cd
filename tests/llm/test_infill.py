"""Operator 13: bit arithmetic against plain search, and exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from metricslake.llm import infill
from metricslake.llm.common import prepare


def plain(i, text, how):
    """The contract's form of one document."""
    text = text or ""
    unit = r"[^\n]*\n|[^\n]+" if how.unit == "line" else r"(?s:.)"
    units = re.findall(unit, text)
    digest = hashlib.sha256(f"{how.seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    p, s, m = how.sentinels
    if not text or any(x in text for x in how.sentinels) or h[2] % 100 >= how.rate:
        return i, n, "plain", None, None, text, text
    form, out = ("spm", s + suf + p + pre + m + mid) if h[3] % 100 < how.spm else ("psm", p + pre + s + suf + m + mid)
    return i, n, form, len(pre), len(mid), out, text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab\n\x8a\x0b日🙂é", max_size=40), min_size=1, max_size=8), st.integers(0, 2**32), st.integers(0, 2**32), st.sampled_from(["line", "char"]))
def test_cuts(texts, one, two, unit):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    hashes = np.full(len(texts), one), np.full(len(texts), two)
    n, low, high, starts = infill.cuts(data, offsets, *hashes, unit)
    for k, t in enumerate(texts):
        units = re.findall(r"[^\n]*\n|[^\n]+" if unit == "line" else r"(?s:.)", t)
        a, b = sorted((one % (len(units) + 1), two % (len(units) + 1)))
        assert n[k] == len(units)
        assert bytes(data[offsets[k] : low[k]]).decode() == "".join(units[:a])
        assert bytes(data[low[k] : high[k]]).decode() == "".join(units[a:b])
        assert starts.rank(high[k : k + 1])[0] - starts.rank(low[k : k + 1])[0] == len("".join(units[a:b]))


def test_marks():
    """Every byte value beside every other, against a plain comparison."""
    data = np.array([x for a in range(256) for b in (0, 9, 10, 11, 127, 128, 138, 255) for x in (a, b)], np.uint8)
    words = data.view("<u8")
    assert ((infill.equal_bytes(words, 10).view(np.uint8) != 0) == (data == 10)).all()
    assert ((infill.first_bytes(words).view(np.uint8) != 0) == (data & 0xC0 != 0x80)).all()
    marks = infill.Marks(infill.equal_bytes(words, 10))
    places = np.flatnonzero(data == 10)
    assert (marks.select(np.arange(len(places))) == places).all()
    assert (marks.rank(np.arange(len(data) + 1)) == np.concatenate([[0], np.cumsum(data == 10)])).all()


TEXTS = [None, "", "\n", "a", "a\n", "a\nb", "\n\n\n", "x<P>y\nz", "<\nS>\n<M\n>", "é\r\n日本\n🙂", "line\n" * 3000, "no end " * 9000]


@pytest.mark.parametrize("how", [infill.Form(), infill.Form(rate=50, spm=0, seed=1), infill.Form("[pre]", "[suf]", "[mid]", unit="char")])
def test_frames(spark, how):
    prepare(spark)
    rng = random.Random(3)
    rows = [(k % 60 if k % 9 else None, TEXTS[k % len(TEXTS)] if k % 2 else "".join(rng.choice("ab \né日") for _ in range(k)), "x") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    found = infill.restored(infill.rewritten(docs, how), how).collect()
    expected = sorted((plain(i, t, how) for i, t, _ in rows), key=repr)
    assert sorted(map(tuple, found), key=repr) == expected
    assert {r.form for r in found} == ({"plain", "psm"} if how.spm == 0 else {"plain", "psm", "spm"})
    assert infill.rewritten(docs.limit(0), how).collect() == []


def test_slices(spark, monkeypatch):
    """Texts beyond the slice come by themselves (run in this process)."""
    monkeypatch.setattr(infill, "SLICE_BYTES", 100)
    texts = ["ab\n" * k for k in range(30)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    n, *_ = infill.cuts(data, offsets, np.zeros(30, int), np.zeros(30, int), "line")
    assert n.tolist() == list(range(30))


def test_sentinels_that_overlap():
    for marks in [("<P>", "<P>", "<M>"), ("aba", "b", "c"), ("xy", "yx", "z"), ("aa", "b", "c"), ("", "b", "c")]:
        with pytest.raises(ValueError):
            infill.Form(*marks)
