"""Tables that change together: stops, replays, other writers, old states, clean-up."""

import datetime as dt

import pytest

from metricslake.sources import lake, published
from metricslake.streaming import landing


def rows(spark, root, name, at=None):
    return sorted(r[0] for r in published.read(spark, root, name, at and published.state(spark, root, at)).collect())


def test_replace_and_append(spark, tmp_path):
    root = str(tmp_path / "set [a]")
    assert published.state(spark, root) == (0, {}, None)
    published.publish(spark, root, {"a": spark.range(3), "b": spark.range(2)})
    published.publish(spark, root, {"a": published.read(spark, root, "a").where("id > 0")}, {"b": spark.range(5, 6), "c": spark.range(1)})
    assert [rows(spark, root, n) for n in "abc"] == [[1, 2], [0, 1, 5], [0]]
    assert [rows(spark, root, n, 1) for n in "ab"] == [[0, 1, 2], [0, 1]]
    published.publish(spark, root, append={"b": spark.range(7, 8).selectExpr("id", "'x' as later")})
    assert sorted(tuple(r) for r in published.read(spark, root, "b").collect() if r.later) == [(7, "x")]
    assert published.merge_parts(spark, root, "b") == 3 and published.merge_parts(spark, root, "b") == 1
    assert rows(spark, root, "b") == [0, 1, 5, 7]
    for bad in (lambda: published.read(spark, root, "no"), lambda: published.state(spark, root, 99), lambda: published.publish(spark, root, {"a": spark.range(1)}, {"a": spark.range(1)})):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("step", range(4))
def test_a_stop_at_every_step_leaves_old_or_new(spark, tmp_path, monkeypatch, step):
    """Stops before the first write, between two tables, before the pointer is written and before its rename."""
    root = str(tmp_path / "set")
    published.publish(spark, root, {"a": spark.range(3), "b": spark.range(3)})

    def stop(*_):
        raise KeyboardInterrupt

    a, b = spark.range(5), spark.range(5)
    with monkeypatch.context() as m:
        if step < 2:
            real, seen = type(a.write).parquet, []

            def parquet(self, path, *more, **options):
                if len(seen) == step:
                    stop()
                seen.append(path)
                return real(self, path, *more, **options)

            m.setattr(type(a.write), "parquet", parquet)
        else:
            m.setattr(lake, "write_bytes" if step == 2 else "rename", stop)
        with pytest.raises(KeyboardInterrupt):
            published.publish(spark, root, {"a": a, "b": b})
    assert [rows(spark, root, n) for n in "ab"] == [[0, 1, 2]] * 2
    published.publish(spark, root, {"a": a, "b": b})
    assert [rows(spark, root, n) for n in "ab"] == [[0, 1, 2, 3, 4]] * 2
    left = {p.name for n in "ab" for p in (tmp_path / "set" / n).iterdir()}
    gone = published.expire(spark, root, unnamed_for=dt.timedelta(0))
    assert len(left) - len({p.split("/")[1] for p in gone}) == 1 and rows(spark, root, "b") == [0, 1, 2, 3, 4]


def test_another_writer(spark, tmp_path):
    root = str(tmp_path / "set")
    base = published.state(spark, root)
    published.publish(spark, root, {"a": spark.range(1)})
    with pytest.raises(published.Conflict):
        published.publish(spark, root, {"a": spark.range(2)}, base=base)
    assert rows(spark, root, "a") == [0]


def test_expire_keeps_what_is_read_or_written(spark, tmp_path):
    root = str(tmp_path / "set")
    for k in range(1, 4):
        published.publish(spark, root, {"a": spark.range(k)}, {"b": spark.range(k)})
    spark.range(9).write.parquet(f"{root}/a/v-writing")  # a writer at work
    assert len(published.expire(spark, root, keep=2)) == 1
    assert [rows(spark, root, "a", 2), rows(spark, root, "b", 3)] == [[0, 1], [0, 0, 0, 1, 1, 2]]
    assert lake.exists(spark, f"{root}/a/v-writing")
    with pytest.raises(ValueError):
        published.state(spark, root, 1)
    with pytest.raises(ValueError):
        published.expire(spark, root, keep=0)


def test_a_batch_is_published_once(spark, tmp_path):
    root, form = str(tmp_path / "lake"), "id long, status string, updated_at timestamp_ntz, repository struct<id:long,full_name:string>"
    batch = spark.createDataFrame([(1, "completed", dt.datetime(2024, 1, 1), (7, "org/a")), (4, "completed", dt.datetime(2024, 1, 2), (7, "org/a"))], form)
    assert [landing.publish_runs_and_mark(batch, k, root) for k in (0, 0, 1, 0)] == [True, False, True, False]
    assert rows(spark, root, landing.RUNS) == [1, 1, 4, 4]
    assert {r.max_run_id for r in published.read(spark, root, landing.MARKS).collect()} == {4}
    landing.publish_runs_and_mark(batch.limit(0), 2, root)  # an empty batch is a step too
    assert published.state(spark, root).step == 2 and rows(spark, root, landing.RUNS) == [1, 1, 4, 4]
