"""Stream forms: replay adds nothing; an unconnected batch is held back."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from metricslake.lake_queries import QUERIES
from metricslake.schemas import CI_RUNS
from metricslake.streaming.landing import batch_time, expire_held, held_runs, landing_stream, late_period_load, store_run_batch

NOW = dt.datetime(2024, 6, 10, 12, 0)


def _run(i, status="completed", repo=1, hours_ago=100):
    upd = NOW - dt.timedelta(hours=hours_ago)
    return {"id": i, "status": status, "event": "push", "html_url": f"u/{i}",
            "created_at": upd.isoformat(), "updated_at": upd.isoformat(),
            "repository": {"id": repo, "full_name": f"o/r{repo}"}}


def _drain(q):
    q.awaitTermination(120)
    assert q.exception() is None


def test_landing_stream(spark, tmp_path):
    landing, lake_root, ckpt = tmp_path / "landing", tmp_path / "lake", tmp_path / "ckpt"
    landing.mkdir()
    # batch 1: repo 1 runs 1..3, run 4 still in progress (fresh) -> stored 1..3
    (landing / "b1.json").write_text(json.dumps([_run(1), _run(2), _run(3), _run(4, "in_progress", hours_ago=1)]))
    _drain(landing_stream(spark, str(landing), str(lake_root), NOW, checkpoint=str(ckpt)))
    runs = lambda: sorted(r.id for r in spark.read.parquet(f"{lake_root}/ci_runs").collect())
    assert runs() == [1, 2, 3]
    # batch 2 does not reach back to the mark (3): held back, repo listed for retry
    (landing / "b2.json").write_text(json.dumps([_run(6), _run(7)]))
    _drain(landing_stream(spark, str(landing), str(lake_root), NOW, checkpoint=str(ckpt)))
    assert runs() == [1, 2, 3]
    retry = spark.read.parquet(f"{lake_root}/ci_runs_retry").collect()
    assert [r.repository_id for r in retry] == [1]
    # batch 3 connects (contains 3) and reaches into the held landing, which lands with it
    (landing / "b3.json").write_text(json.dumps([_run(3), _run(4), _run(5), _run(6)]))
    _drain(landing_stream(spark, str(landing), str(lake_root), NOW, checkpoint=str(ckpt)))
    assert runs() == [1, 2, 3, 4, 5, 6, 7]
    # a failed micro-batch is re-executed with the same id and the same files: the
    # partition-per-batch writes and marks-from-earlier-batches make it a no-op
    batch3 = spark.read.schema(CI_RUNS).option("multiLine", True).json(str(landing / "b3.json"))
    root = str(lake_root)
    store_run_batch(spark, batch3, 2, f"{root}/ci_runs", f"{root}/ci_runs_marks", f"{root}/ci_runs_retry", NOW)
    assert runs() == [1, 2, 3, 4, 5, 6, 7]
    marks = spark.read.parquet(f"{root}/ci_runs_marks")
    assert marks.groupBy().max("max_run_id").first()[0] == 7
    assert held_runs(spark, f"{root}/ci_runs").isEmpty()


def test_late_period_load(spark, tmp_path):
    core, comm, table = tmp_path / "core", tmp_path / "community", str(tmp_path / "downloads")
    for root in (core, comm):
        (root / "download-stats-weekly" / "2024").mkdir(parents=True)
    (core / "download-stats-weekly" / "2024" / "1.json").write_text(
        json.dumps({"_last_update": "2024-01-08 00:00:00", "a": 1, "b": 2}))
    ck = str(tmp_path / "ck")
    _drain(late_period_load(spark, {"core": str(core), "community": str(comm)}, table, checkpoint=ck))
    assert spark.read.parquet(table).count() == 2
    # a late community file for the stored week and a new core week
    (comm / "download-stats-weekly" / "2024" / "1.json").write_text(
        json.dumps({"_last_update": "2024-01-09 00:00:00", "c": 3}))
    (core / "download-stats-weekly" / "2024" / "2.json").write_text(
        json.dumps({"_last_update": "2024-01-15 00:00:00", "a": 4}))
    (core / "download-stats-weekly" / "2024" / "x.json").write_text("{}")
    _drain(late_period_load(spark, {"core": str(core), "community": str(comm)}, table, checkpoint=ck))
    got = sorted((r.repository, r.week, r.extension_name, r.downloads) for r in spark.read.parquet(table).collect())
    assert got == [("community", 1, "c", 3), ("core", 1, "a", 1), ("core", 1, "b", 2), ("core", 2, "a", 4)]
    assert spark.read.parquet(table + "_rejects").count() == 1


def test_overlapping_files_in_one_micro_batch(spark, tmp_path):
    landing, lake_root = tmp_path / "landing", tmp_path / "lake"
    landing.mkdir()
    # an older, unfinished copy of run 3 neither doubles a run nor holds back run 4
    (landing / "b1.json").write_text(json.dumps([_run(1), _run(2), _run(3, "in_progress", hours_ago=10)]))
    (landing / "b2.json").write_text(json.dumps([_run(2), _run(3, hours_ago=2), _run(4, hours_ago=2)]))
    _drain(landing_stream(spark, str(landing), str(lake_root), NOW, checkpoint=str(tmp_path / "ckpt")))
    assert sorted(r.id for r in spark.read.parquet(f"{lake_root}/ci_runs").collect()) == [1, 2, 3, 4]


def test_replay_keeps_the_time_of_its_batch(spark, tmp_path):
    path = str(tmp_path / "times")
    assert batch_time(spark, path, 4, NOW) == NOW
    assert batch_time(spark, path, 4, NOW + dt.timedelta(days=9)) == NOW
    assert batch_time(spark, path, 5, NOW + dt.timedelta(days=9)) == NOW + dt.timedelta(days=9)


def _paths(tmp_path):
    return [str(tmp_path / t) for t in ("runs", "marks", "retry")]


def _store(spark, paths, batch_id, ids, repo=1):
    rows = spark.read.schema(CI_RUNS).json(spark.sparkContext.parallelize([json.dumps(_run(i, repo=repo)) for i in ids]))
    store_run_batch(spark, rows, batch_id, *paths, NOW)


def _stored(spark, paths):
    return sorted(r.id for r in spark.read.parquet(paths[0]).collect())


def _waiting(spark, paths):
    return sorted((r.landing, r.id) for r in held_runs(spark, paths[0]).collect())


def test_held_runs_wait_until_the_gap_is_closed(spark, tmp_path):
    paths = _paths(tmp_path)
    _store(spark, paths, 0, [1, 2, 3])
    _store(spark, paths, 1, [10, 11])
    _store(spark, paths, 2, [14, 15])
    assert _stored(spark, paths) == [1, 2, 3] and _waiting(spark, paths) == [(1, 10), (1, 11), (2, 14), (2, 15)]
    # this one holds the mark but not up to 10: it lands alone
    _store(spark, paths, 3, [3, 4, 5])
    assert _stored(spark, paths) == [1, 2, 3, 4, 5] and len(_waiting(spark, paths)) == 4
    # reaches into the landing of batch 1, not that of batch 2
    _store(spark, paths, 4, [5, 7, 8, 10])
    assert _stored(spark, paths) == [1, 2, 3, 4, 5, 7, 8, 10, 11] and _waiting(spark, paths) == [(2, 14), (2, 15)]
    # a replay reads the state before itself
    _store(spark, paths, 4, [5, 7, 8, 10])
    assert _stored(spark, paths) == [1, 2, 3, 4, 5, 7, 8, 10, 11] and _waiting(spark, paths) == [(2, 14), (2, 15)]
    # two held landings that overlap are one chain
    _store(spark, paths, 5, [15, 16, 20])
    assert len(_waiting(spark, paths)) == 5
    _store(spark, paths, 6, [11, 12, 14])
    assert _stored(spark, paths) == [1, 2, 3, 4, 5, 7, 8, 10, 11, 12, 14, 15, 16, 20] and _waiting(spark, paths) == []
    assert expire_held(spark, paths[0], 7) == [1, 2, 5] and _waiting(spark, paths) == []
    assert expire_held(spark, paths[0], 7) == []


def test_other_repositories_do_not_wait(spark, tmp_path):
    paths = _paths(tmp_path)
    _store(spark, paths, 0, [1, 2], repo=1)
    rows = [_run(9, repo=1), _run(5, repo=2)]
    store_run_batch(spark, spark.read.schema(CI_RUNS).json(spark.sparkContext.parallelize(map(json.dumps, rows))), 1, *paths, NOW)
    assert _stored(spark, paths) == [1, 2, 5] and _waiting(spark, paths) == [(1, 9)]


def test_the_held_runs_scenario_has_every_outcome(spark):
    counts = {r.waits_since: r["count"] for r in QUERIES["held_runs"](spark, "/root/testdata/sf0.001").groupBy("waits_since").count().collect()}
    assert set(counts) >= {None, 1}


def test_a_field_that_appears_later_comes_back(spark, tmp_path):
    landing, lake_root, ckpt = tmp_path / "landing", tmp_path / "lake", str(tmp_path / "ckpt")
    landing.mkdir()
    for name, records in (("a", [_run(1), _run(2)]), ("b", [_run(2), _run(3) | {"actor": {"login": "x"}, "run_attempt": 2}])):
        (landing / f"{name}.json").write_text(json.dumps(records))
        _drain(landing_stream(spark, str(landing), str(lake_root), NOW, checkpoint=ckpt))
    stored = spark.read.parquet(f"{lake_root}/ci_runs")
    got = stored.select("id", F.try_variant_get("record", "$.actor.login", "string"), F.try_variant_get("record", "$.run_attempt", "int"))
    assert sorted(map(tuple, got.collect())) == [(1, None, None), (2, None, None), (3, "x", 2)]
    assert stored.where("id = 3").first().repository.full_name == "o/r1"
    (landing / "c.json").write_text("[{")  # no JSON: an error, not a silent loss
    query = landing_stream(spark, str(landing), str(lake_root), NOW, checkpoint=ckpt)
    with pytest.raises(Exception, match="(?i)malformed|FAILED"):
        query.awaitTermination(120)
