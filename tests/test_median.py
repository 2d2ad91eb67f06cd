import numpy as np
import pytest
from pyspark.sql import functions as F

from metricslake.functions import exact_median


def _expected(rows):
    out = {}
    for k, v in rows:
        if v is not None:
            out.setdefault(k, []).append(v)
    return {k: float(np.median(v)) for k, v in out.items()}


def _rows():
    rng = np.random.default_rng(7)
    rows = []
    # one hot group with a third of the rows, odd and even sized groups, ties, NULLs
    rows += [("hot", float(x)) for x in rng.normal(5, 2, 3001)]
    rows += [("even", float(x)) for x in [4.0, 1.0, 3.0, 2.0]]
    rows += [("ties", 2.0)] * 5 + [("ties", 1.0)] * 2
    rows += [("most", 0.25)] * 2000 + [("most", float(x)) for x in rng.uniform(0, 0.5, 500)]
    rows += [("close", 1.0 + k * 1e-15) for k in range(40)]
    rows += [("wide", s * 10.0**e) for e in range(-300, 300, 7) for s in (1, -1)] + [("wide", 0.0)]
    rows += [("nulls", None), ("nulls", 7.5)]
    rows += [(f"g{i}", float(x)) for i in range(300) for x in rng.uniform(0, 10, 20)]
    rows += [("only_null", None)]
    return rows


@pytest.mark.parametrize("conf", [{}, {"spark.sql.exchange.reuse": "false"}, {"spark.sql.adaptive.enabled": "false"}])
def test_matches_numpy_and_built_in(spark, conf):
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = _rows()
        df = spark.createDataFrame(rows, "k string, v double").repartition(7)
        got = {r.k: r.median for r in exact_median(df, ["k"], "v").collect()}
        built_in = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect() if r.m is not None}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    exp = _expected(rows)
    assert set(got) == set(exp) == set(built_in)
    for k, v in exp.items():
        assert got[k] == built_in[k], k
        assert abs(got[k] - v) <= 1e-12 * max(1.0, abs(v)), k


def test_composite_and_null_keys(spark):
    rows = [(a, b, float(v)) for a in ("x", None) for b in (1, 2) for v in range(a == "x" and 51 or 40)]
    df = spark.createDataFrame(rows, "a string, b int, v double")
    got = {(r.a, r.b): r.m for r in exact_median(df, ["a", "b"], "v", "m").collect()}
    assert got == {("x", 1): 25.0, ("x", 2): 25.0, (None, 1): 19.5, (None, 2): 19.5}


def test_special_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", inf), ("a", 1.0), ("a", -inf), ("b", inf), ("b", 1e300), ("b", 1e299)], "k string, v double")
    assert {r.k: r.median for r in exact_median(df, ["k"], "v").collect()} == {"a": 1.0, "b": 1e300}
