"""Derived tables materialized as parquet, then the reports read them."""

from metricslake.operators import derived
from metricslake.params import BenchmarkFilters
from metricslake.plans import benchmark_reports as br
from metricslake.sources import lake
from metricslake.sources.adapters import model_table

SF = "/root/testdata/sf0.001"


def test_reports_on_materialized_tables(spark, tmp_path):
    root = str(tmp_path / "lake")
    runs, qr, qm = (model_table(spark, SF, t) for t in ("runs", "query_results", "query_metrics"))
    status = lake.materialize_derived(
        spark,
        {
            "benchmark_geomean": lambda: derived.benchmark_geomean(runs, qr, qm),
            "benchmark_query_times": lambda: derived.benchmark_query_times(runs, qr, qm),
        },
        root,
    )
    assert set(status.values()) == {"materialized"}
    g = spark.read.parquet(f"{root}/benchmark_geomean")
    qt = spark.read.parquet(f"{root}/benchmark_query_times")
    live_g = derived.benchmark_geomean(runs, qr, qm, ordered=False)
    # same names and types (parquet reads every column back as nullable)
    assert [(x.name, x.dataType) for x in g.schema] == [(x.name, x.dataType) for x in live_g.schema]
    assert g.count() == live_g.count()
    f = BenchmarkFilters(storage_type="native", benchmarks=("tpch", "tpcds"))
    stored = sorted(tuple(r) for r in br.geomean_report(g, f).collect())
    live = sorted(tuple(r) for r in br.geomean_report(live_g, f).collect())
    assert stored == live and stored
    rows = br.query_times_report(g, qt, f).collect()
    assert rows and all(r.status in ("ok", "failed") for r in rows)
    # the stored table keeps the timestamp order, so date filters prune by statistics
    ts = [r.run_timestamp for r in g.select("run_timestamp").collect()]
    assert ts == sorted(ts)
