"""Feed runs end to end on landed JSON files written by the test."""

import datetime as dt
import json

import pytest

from metricslake import feeds
from metricslake.schemas import CI_JOBS, CI_RUNS
from metricslake.sources import lake

NOW = dt.datetime(2024, 6, 10, 12, 0)


def _run(i, repo, status="completed", hours_ago=100):
    t = (NOW - dt.timedelta(hours=hours_ago)).isoformat()
    return {"id": i, "status": status, "event": "push", "html_url": f"u/{i}", "created_at": t,
            "updated_at": t, "repository": {"id": repo, "full_name": f"org/r{repo}"}}


def _json(spark, tmp_path, name, records, schema=None):
    p = tmp_path / f"{name}.json"
    p.write_text(json.dumps(records))
    return lake.read_json_records(spark, str(p), schema)


def test_ci_feed_cycle(spark, tmp_path):
    root = str(tmp_path / "lake")
    repos = _json(spark, tmp_path, "repos", [
        {"id": 1, "full_name": "org/r1", "private": False, "stars": 3},
        {"id": 2, "full_name": "org/r2", "private": True, "stars": 1},
    ])
    assert feeds.update_repositories(spark, root, repos) == 2
    assert feeds.update_repositories(spark, root, repos) == 0  # unchanged: nothing written
    repos2 = _json(spark, tmp_path, "repos2", [{"id": 2, "full_name": "org/r2", "private": False}])
    assert feeds.update_repositories(spark, root, repos2) == 1
    stored = {r.id: r.private for r in spark.read.parquet(f"{root}/ci_repositories").collect()}
    assert stored == {1: False, 2: False}

    wf = _json(spark, tmp_path, "wf", [{"id": 7, "name": "CI", "path": "ci.yml", "state": "active", "repo": "org/r1"}])
    assert feeds.update_workflows(spark, root, wf, "repo") == 1
    bad = _json(spark, tmp_path, "wf_bad", [{"id": 8, "name": "x", "path": "p", "state": "s", "repo": "no slash"}])
    with pytest.raises(AssertionError):
        feeds.update_workflows(spark, root, bad, "repo")

    landed = _json(spark, tmp_path, "runs", [_run(1, 1), _run(2, 1), _run(3, 1, "in_progress", 1), _run(4, 2)], CI_RUNS)
    retry = feeds.update_runs(spark, root, landed, NOW)
    assert retry.isEmpty()
    assert sorted(r.id for r in feeds.stored_runs(spark, root).collect()) == [1, 2, 4]

    todo = feeds.jobs_to_fetch(spark, root, NOW, remaining=100, main_repo="org/r1")
    assert sorted((r.full_name, r.run_id) for r in todo.collect()) == [("org/r1", 1), ("org/r1", 2), ("org/r2", 4)]
    jobs = _json(spark, tmp_path, "jobs", [
        {"id": 10, "run_id": 1, "name": "build", "workflow_name": "CI", "labels": ["ubuntu"],
         "created_at": NOW.isoformat(), "started_at": NOW.isoformat(), "completed_at": NOW.isoformat()},
    ], CI_JOBS)
    feeds.update_jobs(spark, root, jobs)
    todo = feeds.jobs_to_fetch(spark, root, NOW, remaining=100, main_repo="org/r1")
    assert sorted(r.run_id for r in todo.collect()) == [2, 4]


def test_download_feed_and_runner(spark, tmp_path):
    core = tmp_path / "core" / "download-stats-weekly" / "2024"
    core.mkdir(parents=True)
    (core / "3.json").write_text(json.dumps({"_last_update": "2024-01-22 00:00:00", "a": 5}))
    (core / "4.json").write_text(json.dumps({"a": 1}))
    root = str(tmp_path / "lake")
    rejected = feeds.update_downloads(spark, root, {"core": str(tmp_path / "core")}, batch_id=1)
    assert [r.reason for r in rejected.collect()] == ["missing _last_update"]
    rows = spark.read.parquet(f"{root}/extension_downloads").collect()
    assert [(r.extension_name, r.downloads, r.week) for r in rows] == [("a", 5, 3)]
    # a second run stores nothing new for the stored period
    feeds.update_downloads(spark, root, {"core": str(tmp_path / "core")}, batch_id=2)
    assert spark.read.parquet(f"{root}/extension_downloads").count() == 1

    calls = []

    def bad():
        raise ValueError("boom")

    problems = feeds.run_all_feeds([("bad", bad), ("ok", lambda: calls.append(1))])
    assert calls == [1] and problems == ["feed 'bad' failed: boom"]
    with pytest.raises(RuntimeError):
        feeds.run_all_feeds([("fatal", lambda: (_ for _ in ()).throw(RuntimeError("x")))])


def test_every_landed_field_is_stored_and_landings_do_not_collide(spark, tmp_path):
    root = str(tmp_path / "lake")
    repos = [{"id": 1, "full_name": "org/r1", "private": False, "stars": 3}]
    feeds.update_repositories(spark, root, _json(spark, tmp_path, "r", repos))
    more = [{"id": 1, "full_name": "org/r1", "private": False, "topics": "x"}]
    feeds.update_repositories(spark, root, _json(spark, tmp_path, "r2", more))
    assert [(r.stars, r.topics) for r in spark.read.parquet(f"{root}/ci_repositories").collect()] == [(None, "x")]

    # two landings with one as_of: the second, an overlapping one, adds to the first
    first = [{**_run(i, 1), "actor": "a"} for i in (1, 2)]
    feeds.update_runs(spark, root, _json(spark, tmp_path, "a", first), NOW)
    feeds.update_runs(spark, root, _json(spark, tmp_path, "b", [{**_run(i, 1), "actor": "b"} for i in (2, 3)]), NOW)
    stored = {r.id: r.actor for r in feeds.stored_runs(spark, root).collect()}
    assert stored == {1: "a", 2: "a", 3: "b"}
    # a rejected repository is landed again, reaching back, in the same run
    retry = feeds.update_runs(spark, root, _json(spark, tmp_path, "c", [{**_run(6, 1), "actor": "c"}]), NOW)
    assert [r.repository_id for r in retry.collect()] == [1]
    feeds.update_runs(spark, root, _json(spark, tmp_path, "d", [{**_run(i, 1), "actor": "d"} for i in (3, 4, 6)]), NOW)
    assert sorted(r.id for r in feeds.stored_runs(spark, root).collect()) == [1, 2, 3, 4, 6]


def test_jobs_lie_by_the_month_of_their_run(spark, tmp_path):
    """Jobs of old months are not read for recent runs; jobs of unknown runs always are."""
    root = str(tmp_path / "lake")
    old = {**_run(1, 1), "created_at": "2020-05-03T00:00:00"}
    feeds.update_repositories(spark, root, _json(spark, tmp_path, "r", [{"id": 1, "full_name": "org/r1", "private": False}]))
    feeds.update_runs(spark, root, _json(spark, tmp_path, "a", [old, *(_run(i, 1) for i in (2, 3, 4, 5))]), NOW)
    job = {"name": "build", "workflow_name": "w", "labels": ["x"]}
    feeds.update_jobs(spark, root, _json(spark, tmp_path, "j", [{"id": 10, "run_id": 1, **job}, {"id": 11, "run_id": 2, **job}, {"id": 12, "run_id": 99, **job}]))
    feeds.update_jobs(spark, root, _json(spark, tmp_path, "k", [{"id": 13, "run_id": 2, **job}, {"id": 14, "run_id": 4, **job}, {"id": 15, "run_id": None, **job}]))
    jobs = spark.read.parquet(f"{root}/ci_jobs")
    months = {r.id: str(r.run_month) for r in jobs.collect()}
    recent = str(feeds.stored_runs(spark, root).where("id = 2").selectExpr("trunc(created_at, 'month')").first()[0])
    assert months == {10: "2020-05-01", 11: recent, 12: "None", 13: recent, 14: recent, 15: "None"}
    todo = feeds.jobs_to_fetch(spark, root, NOW, 1000, "org/r1")
    assert sorted(r.run_id for r in todo.collect()) == [3, 5]
