"""Driver contract: flagship, registry and oracles agree at sf0.001 (DuckDB as brute force)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from metricslake.queries import QUERIES
from metricslake.sources.tables import TEST_TABLES, table_path

SF = "/root/testdata/sf0.001"


def test_entry_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["run_id", "invocation_id", "run_timestamp"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert sorted(set(QUERIES) - set(o)) == []


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return repr(v)


@pytest.mark.skipif(os.environ.get("QUICK") == "1", reason="QUICK=1 skips the full oracle sweep")
def test_all_queries_match_oracle_sf0001(spark):
    con = duckdb.connect()
    for t in TEST_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{table_path(SF, t)}')")
    bad = []
    for name, fn in QUERIES.items():
        df = fn(spark, SF)
        s_cols, s_rows = df.columns, df.collect()
        rel = con.sql(entry.oracle_sql()[name])
        o_cols, o_rows = rel.columns, rel.fetchall()
        if sorted(s_cols) != sorted(o_cols):
            bad.append((name, "columns"))
            continue
        so = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        oo = sorted(range(len(o_cols)), key=lambda i: o_cols[i])
        a = sorted("|".join(_norm(r[i]) for i in so) for r in s_rows)
        b = sorted("|".join(_norm(r[i]) for i in oo) for r in o_rows)
        if a != b:
            bad.append((name, len(a), len(b)))
    assert bad == []
