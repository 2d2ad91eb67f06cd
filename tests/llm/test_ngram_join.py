"""Operator 1 against all pairs."""

import random
import tracemalloc

import numpy as np
import pytest

from metricslake.llm import ngram_join as nj
from metricslake.llm.components import components
from metricslake.llm.registry import op1_ngram_join

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, component_id string, n int"


def shingles(text, size):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, part, whole):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in by.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    for a, b in pairs:
        inter = len(sets[a] & sets[b])
        if whole * inter >= part * (len(sets[a]) + len(sets[b]) - inter):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_query(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op1_ngram_join(spark, SF).collect()}
    assert got == brute(docs, 3, 90, 100)


@pytest.mark.parametrize("size, part", [(3, 90), (5, 80), (1, 50)])
def test_groups_of_near_copies(spark, monkeypatch, size, part):
    monkeypatch.setattr(nj, "CHUNK_ROWS", 16)
    monkeypatch.setattr(nj, "LEAF_ROWS", 3)
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    docs = []
    for i in range(150):
        words = list(base) if i % 3 else [rng.choice(vocabulary) for _ in range(rng.randrange(1, 50))]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append((1000 - i, " ".join(words)))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.join(df, size, nj.Threshold(part, 100)).collect()}
    assert got == brute(docs, size, part, 100)


def test_odd_rows(spark):
    texts = [None, "", " \n\t", "one", "ONE", "two words", "two  Words", "É a b c", "é a b c", "a b c", "a b c", "x " * 4000, "x " * 3000, "one"]
    rows = list(enumerate(texts)) + [(3, "one"), (None, "one"), (3, "two words")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = nj.join(df, 3, nj.Threshold(90, 100)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert [by[i, 0] for i in range(3)] == [0, 1, 2] and by[None, 1] is None
    assert {by[i, 1] for i in (3, 4, 13, 5, 6)} == {3}  # one id with two texts links both
    assert by[7, 2] == 7 and by[8, 2] == 8 and by[11, 1] == by[12, 1] == 11 and by[9, 1] == 9 and by[10, 1] == 10
    assert nj.join(df.limit(0), 3, nj.Threshold(90, 100)).collect() == []


def test_bound_holds_and_tree_prunes_nothing_needed():
    rng = np.random.default_rng(2)
    threshold = nj.Threshold(80, 100)
    sets = [np.unique(rng.integers(0, 2**63, 40)).astype(np.uint64) for _ in range(30)]
    sets += [np.unique(np.concatenate([s[:36], rng.integers(0, 2**63, 3).astype(np.uint64)])) for s in sets]
    n = np.array([len(s) for s in sets])
    vec = np.stack([np.bincount((s >> np.uint64(58)).astype(int), minlength=nj.GROUPS) for s in sets])
    found = {(a, b) for q, p, _ in nj.Tree(n, vec).near(n, vec, threshold) for a, b in zip(q.tolist(), p.tolist())}
    for a in range(len(sets)):
        for b in range(len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (n[a] + n[b] - both):
                assert (a, b) in found
    assert len(found) < len(sets) ** 2 / 4


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 105), (105, 103), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 103: 100, 105: 100}


def group(rng, nodes, shingles, key=0):
    """Points of one group whose nodes have the given common shingles."""
    sketch = np.full((nodes, nj.SKETCH), nj.NO_KEY)
    for k, own in enumerate(shingles):
        low = np.sort(own)[: nj.SKETCH]
        sketch[k, : len(low)] = low
    vec = rng.integers(0, 4, (nodes, nj.GROUPS)).astype("u1")
    return nj.Group(np.zeros(nodes, int), np.full(nodes, key), np.arange(nodes), vec.sum(1, dtype=np.int64), vec, np.arange(nodes), np.zeros(nodes, int), sketch)


def test_a_pair_passes_under_its_smallest_common_shingle_and_few_others():
    rng = np.random.default_rng(3)
    own = [rng.choice(60, rng.integers(1, 40), replace=False) for _ in range(30)]
    i, j = map(np.array, zip(*[(a, b) for a in range(30) for b in range(a)]))
    passed = np.zeros(len(i), int)
    for key in range(60):
        held = np.array([key in own[a] and key in own[b] for a, b in zip(i, j)])
        met = group(rng, 30, own, key).first_met(i, j)
        first = np.array([len(c := np.intersect1d(own[a], own[b])) > 0 and c[0] == key for a, b in zip(i, j)])
        assert met[first].all()
        passed += held & met
    shared = np.array([len(np.intersect1d(own[a], own[b])) for a, b in zip(i, j)])
    assert (passed[shared > 0] >= 1).all() and passed.sum() < 0.5 * shared.sum()


def test_memory_of_a_pair_of_chunks():
    """1,024 points with 200 of 20,000 common shingles each, all of whose pairs pass."""
    rng = np.random.default_rng(4)
    own = [rng.choice(20_000, 200, replace=False) for _ in range(1024)]
    points = group(rng, 1024, own)._replace(vec=np.full((1024, nj.GROUPS), 3, "u1"), n=np.full(1024, 192))
    tracemalloc.start()
    found = nj.all_pairs(points, nj.Threshold(80, 100))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) > 400_000 and peak < 200 << 20


def test_cells_bring_every_two_parts_together(spark, monkeypatch):
    monkeypatch.setattr(nj, "CHUNK_ROWS", 4)
    parts = [0] * 30 + [1] * 3 + list(range(2, 14))
    rows = [(7, node, part, 0, 30, 15) for node, part in enumerate(parts)]
    cells = nj._crossed(spark.createDataFrame(rows, "key long, node long, part long, main long, mine long, others long")).collect()
    by = {}
    for r in cells:
        by.setdefault((r.ci, r.cj), []).append(r)
    met = set()
    for own in by.values():
        two = len({r.side for r in own}) == 2
        met |= {(a.node, b.node) for a in own for b in own if a.node < b.node and a.part != b.part and (not two or a.side != b.side)}
    assert met == {(a, b) for b in range(45) for a in range(b) if parts[a] != parts[b]}
    assert sum(r.part == 0 for r in cells) == 30 * 4  # once for each chunk of the others
