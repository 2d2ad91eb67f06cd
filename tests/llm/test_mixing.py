"""Operator 4: shares against water-filling with fractions, prefixes against a plain pass."""

import hashlib
import random
from fractions import Fraction

from pyspark.sql import functions as F

from metricslake.llm import mixing

LEVELS = ["a", "b"]


def columns():
    return {"a": F.col("a"), "b": F.col("b")}


def fill(budget, caps, weights):
    """Shares by raising one level for all until the budget is used, in fractions."""
    share, open_ = dict.fromkeys(caps, Fraction(0)), {k for k in caps if weights[k] and caps[k]}
    left = Fraction(budget)
    while open_ and left:
        total = sum(weights[k] for k in open_)
        step = min(left / total, min((caps[k] - share[k]) / Fraction(weights[k]) for k in open_))
        for k in open_:
            share[k] += step * weights[k]
        left -= step * total
        open_ = {k for k in open_ if share[k] < caps[k]}
    return share


def test_shares_against_water_filling(spark):
    rng = random.Random(6)
    for trial in range(4):
        rows = [(a, b, rng.randrange(1, 200), 5) for a in "xyz" for b in "pqrs" if rng.random() < 0.8]
        weights = {"a": {"x": rng.randrange(5), "y": 3}, "b": {"p": 7, "q": rng.randrange(3)}}
        num = rng.choice([1, 3, 9])
        w = lambda l, v: weights[l].get(v, 1)  # noqa: B023, E731
        got = mixing.budgets(spark.createDataFrame(rows, "a string, b string, tokens long, docs long"), LEVELS, weights, (num, 10), 2).collect()
        cap = {(a, b): 2 * t if w("a", a) and w("b", b) else 0 for a, b, t, _ in rows}
        budget = min(sum(r[2] for r in rows) * num // 10, sum(cap.values()))
        assert sum(r.share for r in got) == budget, trial
        tops = {a for a, _ in cap}
        upper = fill(budget, {a: sum(c for (x, _), c in cap.items() if x == a) for a in tops}, {a: w("a", a) for a in tops})
        own = {a: sum(r.share for r in got if r.a == a) for a in tops}
        assert all(abs(own[a] - upper[a]) < 1 for a in tops)
        for a in tops:
            caps = {b: c for (x, b), c in cap.items() if x == a}
            lower = fill(own[a], caps, {b: w("b", b) for b in caps})
            assert all(abs(r.share - lower[r.b]) < 1 and 0 <= r.share <= caps[r.b] for r in got if r.a == a)


def docs(spark):
    rng = random.Random(7)
    rows = [(i, " ".join("w" * rng.randrange(1, 30)), rng.choice(["x", "x", "x", "y", None]), rng.choice("pq"), 1, "c") for i in range(300)]
    rows += [(None, "a b c", "x", "p", 1, "c"), (7, "one", "x", "p", 1, "c"), (7, "one", "x", "p", 1, "c"), (900, None, "x", "p", 1, "c"), (901, "", "z", "p", 1, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, a string, b string, n_tokens int, share string")


def test_prefixes_against_a_plain_pass(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    df, seed = docs(spark), 3
    weights = {"a": {"x": 1, "y": 9}}
    got = mixing.select(df, columns(), weights, (1, 2), 2, seed).collect()
    leaves = {}
    for r in df.collect():
        if r.text and r.text.split():
            name = f"text:{hashlib.md5(r.text.encode()).hexdigest()}" if r.doc_id is None else r.doc_id
            leaves.setdefault((r.a or "(none)", r.b), []).append((name, len(r.text.split())))
    table = spark.createDataFrame([(*k, sum(t for _, t in v), len(v)) for k, v in leaves.items()], "a string, b string, tokens long, docs long")
    want = []
    for r in mixing.budgets(table, LEVELS, weights, (1, 2), 2).collect():
        whole, rest = divmod(r.share, r.tokens)
        place = lambda d: int(hashlib.md5(f"{seed}:{whole + 1}:{d}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        for doc, n in sorted(leaves[r.a, r.b], key=lambda x: (place(x[0]), x[1])):
            part = min(n, rest)
            rest -= part
            if whole * n + part:
                want.append(("None" if str(doc).startswith("text:") else str(doc), r.a, r.b, n, whole + (part == n), whole * n + part))
    assert sorted((str(r.doc_id), r.a, r.b, r.n_tokens, r.epochs, r.taken_tokens) for r in got) == sorted(want)
    total = sum(n for v in leaves.values() for _, n in v)
    assert sum(r.taken_tokens for r in got) == total // 2


def test_mixed_rows_are_whole(spark):
    df = docs(spark)
    kept = mixing.mixed(df, columns(), {}, (1, 2), 3)
    assert kept.columns == df.columns
    taken = mixing.select(df, columns(), {}, (1, 2), 1, 3)
    ids = lambda f: sorted(str(r.doc_id) for r in f.filter("length(text) > 0").collect())
    assert set(ids(kept)) == {str(r.doc_id) for r in taken.collect()}
    assert mixing.select(df.limit(0), columns(), {}, (1, 2)).collect() == []
    assert mixing.mixed(df.limit(0), columns(), {}, (1, 2)).collect() == []


def test_rows_without_an_id_and_copies(spark):
    """The share is met by rows without an id, with different texts or all the same."""
    for text in ("concat('a b ', id)", "'a b c'"):
        df = spark.range(20_000).selectExpr("cast(null as long) as doc_id", f"{text} as text", "'x' as a", "'p' as b")
        taken = mixing.select(df, columns(), {}, (3, 5), 1, 3)
        assert taken.agg(F.sum("taken_tokens")).first()[0] == 36_000
        assert taken.count() == 12_000
        assert abs(mixing.mixed(df, columns(), {}, (3, 5), 3).count() - 12_000) <= (0 if "id" in text else 400)
