"""Property tests: exact operators against brute force on generated inputs."""

import statistics

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from metricslake.functions import exact_median
from metricslake.operators import changes

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

groups = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(-50, 50)), min_size=1, max_size=120
)


@SETTINGS
@given(rows=groups)
def test_median_equals_brute_force(spark, rows):
    df = spark.createDataFrame([(k, float(v)) for k, v in rows], "k string, v double")
    got = {r.k: r.median for r in exact_median(df, ["k"], "v").collect()}
    exp = {}
    for k, v in rows:
        exp.setdefault(k, []).append(float(v))
    assert got == {k: statistics.median(v) for k, v in exp.items()}


rowsets = st.lists(
    st.tuples(st.integers(0, 8), st.sampled_from(["x", "y", None])), max_size=10, unique_by=lambda r: r[0]
)


@SETTINGS
@given(target=rowsets, batch=rowsets)
def test_upsert_matches_dict_merge(spark, target, batch):
    schema = "id long, v string"
    t = spark.createDataFrame(target, schema)
    b = spark.createDataFrame(batch, schema)
    merged = dict(target)
    merged.update(dict(batch))
    once = changes.upsert_changed(t, b, ["id"])
    assert sorted(tuple(r) for r in once.collect()) == sorted(merged.items())
    assert changes.changed_rows(b, once).isEmpty()  # a second upsert would write nothing
    assert changes.snapshot_diff(once, once).isEmpty()
