"""Operators 2 and 5 against all pairs."""

import numpy as np
import pytest

from metricslake.llm import ann, exact_topk, tiles
from metricslake.llm.registry import op2_ann, op5_topk

SF = "/root/testdata/sf0.1"
#: On nearly random vectors at most this share of the rows is compared by distance.
SHARE = 0.3


def vectors(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)


def lists(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_exact_top_k(spark):
    ids, x = vectors(spark, SF)
    e = np.floor(x * 1024).astype(np.int64)
    got = lists(op5_topk(spark, SF).collect())
    assert sorted(got) == sorted(ids[ids % 100 == 0])
    for q, found in got.items():
        s = e @ e[ids == q][0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:10]
        assert found == [(ids[i], s[i]) for i in order]


def test_recall_and_distances(spark):
    ids, x = vectors(spark, SF)
    got = lists(op2_ann(spark, SF).collect())
    hit = total = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hit += len({ids[i] for i in order} & {v for v, _ in found})
        total += 10
        assert len(found) == 10 and all(s == d[ids == v][0] for v, s in found)
        assert found == sorted(found, key=lambda f: (f[1], f[0]))
    assert sorted(got) == sorted(ids[ids % 100 == 0]) and hit >= 0.9 * total


def test_recall_over_several_blocks(spark, monkeypatch):
    """Whole lists again with blocks and tiles of few rows, and the share of rows that is compared by distance."""
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 150)
    monkeypatch.setattr(tiles, "TILE_ROWS", 7)
    ids, x = vectors(spark, SF)
    got = lists(op2_ann(spark, SF).collect())
    model = ann.fit(spark.read.parquet(f"{SF}/embeddings.parquet"))[x.shape[1]]
    codes, hit, near = model.of(x), 0, 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hit += len({ids[i] for i in order} & {v for v, _ in found})
        near += int((ann.hamming(codes, codes[ids == q][0]) <= model.radius).sum())
    print("recall", hit / (10 * len(got)), "share", near / len(got) / len(ids), "radius", model.radius)
    assert len(got) == (ids % 100 == 0).sum() and hit >= 9 * len(got)
    assert near < SHARE * len(got) * len(ids)


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 256, (600, 4), dtype=np.uint8)
    index = ann.MultiIndex.read(ann.MultiIndex.build(codes).stored(), len(codes))
    for radius in range(0, 33, 3):
        for code in codes[:20]:
            assert index.within(code, radius).tolist() == np.flatnonzero(ann.hamming(codes, code) <= radius).tolist()


SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [0.0, 0.0]), (6, []), (None, [1.0, 1.0])]
    rows += [(7, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [1.0, 1.0, 1.0]), (200, None), (300, [2.0, 2.0, 2.0]), (10, [1e30, -1e30])]
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)


def test_odd_rows(spark):
    df, by = odd(spark), exact_topk.query_rows()
    got = lists(exact_topk.top_k(df, by).collect())
    top = 2**63 - 1
    assert got[0] == [(10, top), (7, 1024**2), (8, 1024**2), (5, 0), (100, 0)]
    assert got[300] == [(9, 3 * 2 * 1024**2)] and sorted(got) == [0, 100, 300]
    near = lists(ann.nearest(df, by, ann.fit(df)).collect())
    assert [v for v, _ in near[0]] == [7, 8, 100, 10] and [v for v, _ in near[300]] == [9] and sorted(near) == [0, 100, 300]
    none = df.filter("vec_id is null")
    assert exact_topk.top_k(none, by).collect() == [] and ann.nearest(none, by, ann.fit(none)).collect() == []


def test_many_equal_vectors(spark):
    rows = [(i, [0.5, 0.5] if i % 3 else [0.1 * (i % 7) + 0.1, 0.2], "x", 1) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = lists(ann.nearest(df, exact_topk.query_rows(), ann.fit(df)).collect())
    assert [v for v, _ in got[100]] == [i for i in range(30) if i % 3][:10]


@pytest.mark.parametrize("largest", [True, False])
def test_first_k(largest):
    rng = np.random.default_rng(3)
    for n in (0, 3, 10, 50):
        scores, ids = rng.integers(0, 5, n), rng.permutation(n)
        want = sorted(range(n), key=lambda i: ((-1 if largest else 1) * scores[i], ids[i]))[:10]
        assert tiles.first_k(scores, ids, 10, largest).tolist() == want
