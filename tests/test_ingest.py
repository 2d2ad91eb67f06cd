"""Ingestion operators on hand-made batches: cuts, gates, budgets, upserts, diffs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from metricslake.operators import changes, ingest
from metricslake.schemas import CI_REPOSITORIES_METADATA, CI_RUNS

NOW = dt.datetime(2024, 6, 10, 12, 0)


def _runs(spark, rows):
    """rows: (id, status, updated_at, repo_id)"""
    return spark.createDataFrame(
        [
            (i, st, "push", None, upd - dt.timedelta(hours=1), upd, {"id": repo, "full_name": f"o/r{repo}"})
            for i, st, upd, repo in rows
        ],
        CI_RUNS,
    )


def _marks(spark, rows):
    return spark.createDataFrame(rows, CI_REPOSITORIES_METADATA)


def test_completed_prefix_cut_mark_and_stale(spark):
    fresh, stale = NOW - dt.timedelta(hours=1), NOW - dt.timedelta(hours=72)
    runs = _runs(
        spark,
        [
            # repo 1: mark 10; in-progress fresh run 14 blocks 14 and later
            (9, "completed", fresh, 1), (11, "completed", fresh, 1), (12, "in_progress", stale, 1),
            (13, "completed", fresh, 1), (14, "in_progress", fresh, 1), (15, "completed", fresh, 1),
            # repo 2: no mark; nothing blocks; id 0 is a real id
            (0, "completed", fresh, 2), (5, "queued", stale, 2),
        ],
    )
    kept = ingest.completed_prefix(runs, _marks(spark, [(1, 10)]), NOW)
    assert sorted(r.id for r in kept.collect()) == [0, 5, 11, 12, 13]
    # without an age limit every unfinished run blocks
    kept_all = ingest.completed_prefix(runs, _marks(spark, [(1, 10)]), NOW, stale_hours=None)
    assert sorted(r.id for r in kept_all.collect()) == [0, 11]
    marks = {r.repository_id: r.max_run_id for r in ingest.new_high_water_mark(kept).collect()}
    assert marks == {1: 13, 2: 5}


def test_contiguity_gate(spark):
    t = NOW
    batch = _runs(
        spark,
        [(21, "completed", t, 1), (20, "completed", t, 1),  # reaches mark 20
         (31, "completed", t, 2), (32, "completed", t, 2),  # misses mark 30
         (41, "completed", t, 3),  # no mark
         (51, "completed", t, 4)],  # misses mark 50 but the listing is exhausted
    )
    marks = _marks(spark, [(1, 20), (2, 30), (4, 50)])
    exhausted = spark.createDataFrame([(4,)], "repository_id long")
    g = ingest.contiguity_gate(batch, marks, exhausted)
    assert sorted(r.id for r in g.accepted.collect()) == [20, 21, 41, 51]
    assert [r.repository_id for r in g.rejected.collect()] == [2]


def test_reference_id_cut(spark):
    recs = spark.createDataFrame(
        [(g, i) for g, ids in {"a": [1, 3, 5, 7], "b": [2, 4, 6], "c": [1, 2], "d": [8, 9]}.items() for i in ids],
        "g string, id long",
    )
    refs = spark.createDataFrame([("a", 5), ("b", 5), ("c", 0), ("d", 3)], "g string, ref long")
    cut = ingest.reference_id_cut(recs, refs, "g")
    assert sorted((r.g, r.id) for r in cut.kept.collect()) == [
        ("a", 5), ("a", 7), ("c", 1), ("c", 2), ("d", 8), ("d", 9)
    ]
    assert [r.g for r in cut.invalid.collect()] == ["b"]  # 5 inside 2..6 but absent
    smaller = ingest.reference_id_cut(recs, refs.where("g = 'a'"), "g", fetch_smaller=True)
    assert sorted(r.id for r in smaller.kept.where("g = 'a'").collect()) == [1, 3, 5]
    with pytest.raises(ValueError):
        ingest.reference_id_cut(recs, refs, "g", strict=True)


def test_runs_without_jobs_and_lists(spark):
    t = NOW
    runs = _runs(
        spark,
        [(1, "completed", t, 1), (2, "completed", t, 1), (3, "in_progress", t, 1),
         (4, "completed", t - dt.timedelta(days=20), 2), (5, "completed", t, 2)],
    )
    jobs = spark.createDataFrame([(2,)], "run_id long")
    work = ingest.runs_without_jobs(runs, jobs, NOW)
    assert [(r.repo_id, r.run_id) for r in work.collect()] == [(1, 1), (2, 5)]
    repos = spark.createDataFrame([(1, "o/r1"), (2, "o/r2"), (3, "o/r3")], "id long, full_name string")
    per = [(r.full_name, r.run_id) for r in ingest.run_ids_per_repo(repos, work).collect()]
    assert per == [("o/r1", 1), ("o/r2", 5), ("o/r3", None)]


def test_repo_budgets(spark):
    def of(names, remaining=100):
        df = spark.createDataFrame([(n,) for n in names], "full_name string")
        return {r.full_name: r.budget for r in ingest.repo_budgets(df, remaining, "main").collect()}

    assert of(["main"]) == {"main": 80}  # the main repository alone
    assert of(["a", "b", "c"]) == dict.fromkeys("abc", 26)
    assert of([]) == {}
    many = of(["main", *(f"r{i}" for i in range(24))])
    assert many["main"] == 8 and set(many.values()) == {8, 3}


def test_budgeted_work_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = [("hot", rnd.randrange(10**6)) for _ in range(5000)]
    rows += [(f"g{i}", rnd.randrange(1000)) for i in range(20) for _ in range(rnd.randrange(0, 8))]
    names = sorted({r[0] for r in rows} | {"main"})
    repos = spark.createDataFrame([(n,) for n in names], "full_name string")
    work = spark.createDataFrame(rows, "full_name string, run_id long")
    got = [(r.full_name, r.run_id) for r in ingest.budgeted_work(work, repos, 200, "main").collect()]
    k = (160 - 16) // (len(names) - 1)
    assert got == [(g, v) for g in names for v in sorted(r[1] for r in rows if r[0] == g)[:k]]
    plan = ingest.budgeted_work(work, repos, 200, "main")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # groups are cut before the shuffle


def test_repository_name_must_match_whole(spark):
    df = spark.createDataFrame([("org/x",), ("org/x\n",), ("org",), (None,)], "repo string")
    valid, rejected = ingest.tag_with_repository(df, "repo")
    assert [r.repository for r in valid.collect()] == ["org/x"] and rejected.count() == 3


def test_budgeted_work(spark):
    repos = spark.createDataFrame([("main",), ("x",), ("y",)], "full_name string")
    work = spark.createDataFrame(
        [("main", i) for i in range(20)] + [("x", i) for i in range(10)] + [("y", None)],
        "full_name string, run_id long",
    )
    # total 80; main 8; others (80 - 8) / 2 = 36
    got = ingest.budgeted_work(work, repos, 100, "main").collect()
    assert [r.run_id for r in got if r.full_name == "main"] == list(range(8))
    assert [r.run_id for r in got if r.full_name == "x"] == list(range(10))


def test_tag_with_repository(spark):
    wf = spark.createDataFrame([(1, "org/repo"), (2, "bad name/x"), (3, None)], "id long, r string")
    ok, bad = ingest.tag_with_repository(wf, "r")
    assert [r.id for r in ok.collect()] == [1] and sorted(r.id for r in bad.collect()) == [2, 3]


def _table(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, v double")


def test_upsert_changed_idempotent(spark):
    target = _table(spark, [(1, "a", 1.0), (2, "b", None), (3, "c", 3.0)])
    batch = _table(spark, [(2, "b", None), (3, "c", 30.0), (4, "d", 4.0)])
    assert sorted(tuple(r) for r in changes.changed_rows(batch, target).collect()) == [
        (3, "c", 30.0), (4, "d", 4.0)
    ]
    once = changes.upsert_changed(target, batch, ["id"])
    twice = changes.upsert_changed(once, batch, ["id"])
    exp = [(1, "a", 1.0), (2, "b", None), (3, "c", 30.0), (4, "d", 4.0)]
    assert sorted(tuple(r) for r in once.collect()) == exp
    assert sorted(tuple(r) for r in twice.collect()) == exp
    assert changes.changed_rows(batch, once).isEmpty()  # nothing to write the second time


def test_upsert_rejects_duplicate_keys(spark):
    target = _table(spark, [(1, "a", 1.0)])
    batch = _table(spark, [(2, "x", 1.0), (2, "y", 2.0)])
    with pytest.raises(Exception, match="duplicate keys"):
        changes.upsert_changed(target, batch, ["id"]).collect()


def test_snapshot_diff_and_changes(spark):
    before = _table(spark, [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)])
    after = _table(spark, [(1, "a", 1.0), (2, "b", 20.0), (4, "d", 4.0)])
    assert changes.snapshot_diff(before, before).isEmpty()
    assert [tuple(r) for r in changes.snapshot_diff(before, after).collect()] == [
        (2, "b", 20.0), (4, "d", 4.0)
    ]
    kinds = {r.id: (r.change_type, r.v) for r in changes.snapshot_changes(before, after, ["id"]).collect()}
    assert kinds == {2: ("update", 20.0), 3: ("delete", 3.0), 4: ("insert", 4.0)}


def test_column_profile(spark):
    df = spark.createDataFrame(
        [(1.0, 5, "x"), (float("nan"), None, "y"), (None, 7, None)], "d double, i int, s string"
    )
    prof = {r.column_name: r for r in changes.column_profile(df).collect()}
    assert prof["d"].contains_nan is True and prof["d"].null_count == 1
    assert (prof["i"].min_value, prof["i"].max_value, prof["i"].contains_nan) == ("5", "7", False)
    assert (prof["s"].min_value, prof["s"].max_value, prof["s"].null_count) == ("x", "y", 1)
    assert changes.max_id(df.select(F.col("i").alias("id"))).first().max_id == 7
