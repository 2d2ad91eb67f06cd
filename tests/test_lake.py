"""Table I/O: create/append/replace/copy/materialize/compact and JSON records."""

import json

import pytest
from pyspark.sql import functions as F

from metricslake.operators import changes
from metricslake.queries import QUERIES
from metricslake.schemas import CI_RUNS, EXTENSION_DOWNLOADS
from metricslake.sources import change_log, lake
from metricslake.sources.adapters import model_table


def test_create_modes_and_append_by_name(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    assert lake.create_table_as(spark, p, df, with_no_data=True)
    assert spark.read.parquet(p).isEmpty()
    assert not lake.create_table_as(spark, p, df, if_not_exists=True)
    with pytest.raises(ValueError):
        lake.create_table_as(spark, p, df)
    with pytest.raises(ValueError):
        lake.require_non_empty(spark, p, "t")
    # append by name: columns in another order and a narrower type
    lake.append_records(spark, p, spark.createDataFrame([("b", 2)], "name string, id int"))
    assert [tuple(r) for r in spark.read.parquet(p).collect()] == [(2, "b")]
    lake.require_non_empty(spark, p)
    with pytest.raises(ValueError):
        lake.append_records(spark, p, spark.createDataFrame([(3,)], "id long"))
    assert lake.create_table_as(spark, p, df, or_replace=True)
    assert [tuple(r) for r in spark.read.parquet(p).collect()] == [(1, "a")]


def test_typed_table_and_read_or_empty(spark, tmp_path):
    p = str(tmp_path / "downloads")
    assert lake.read_or_empty(spark, p, EXTENSION_DOWNLOADS).isEmpty()
    assert lake.create_typed_table(spark, p, EXTENSION_DOWNLOADS)
    assert not lake.create_typed_table(spark, p, EXTENSION_DOWNLOADS)
    assert spark.read.parquet(p).schema == EXTENSION_DOWNLOADS


def test_replace_reads_itself(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(10).write.parquet(p)
    lake.replace_table(spark, p, spark.read.parquet(p).where("id % 2 = 0"))
    assert sorted(r.id for r in spark.read.parquet(p).collect()) == [0, 2, 4, 6, 8]


def test_copy_and_materialize(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    spark.range(3).write.parquet(f"{src}/a")
    status = lake.copy_tables(spark, src, dst, ["a", "missing"])
    assert status == {"a": "copied", "missing": "missing"}
    assert spark.read.parquet(f"{dst}/a").count() == 3
    builders = {"x": lambda: spark.range(2), "y": lambda: spark.range(5)}
    assert lake.materialize_derived(spark, builders, dst, only=["y"]) == {"y": "materialized"}
    assert spark.read.parquet(f"{dst}/y").count() == 5 and not lake.exists(spark, f"{dst}/x")
    with pytest.raises(ValueError):
        lake.materialize_derived(spark, builders, dst, only=["nope"])


def test_compact_table(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(1000).repartition(20).write.parquet(p)
    n = lake.compact_table(spark, p, target_file_bytes=10**9)
    files = [f for f in (tmp_path / "t").iterdir() if f.name.endswith(".parquet")]
    assert n == 1 and len(files) == 1
    assert spark.read.parquet(p).count() == 1000


def test_read_json_records(spark, tmp_path):
    p = tmp_path / "runs.json"
    recs = [
        {"id": 5, "status": "completed", "event": "push", "html_url": "u",
         "created_at": "2024-01-01T00:00:00", "updated_at": "2024-01-01T01:00:00",
         "repository": {"id": 1, "full_name": "o/r"}, "extra": True},
        {"id": 6, "status": "queued", "event": "push", "html_url": "u",
         "created_at": "2024-01-02T00:00:00", "updated_at": "2024-01-02T00:00:00",
         "repository": {"id": 1, "full_name": "o/r"}},
    ]
    p.write_text(json.dumps(recs))
    typed = lake.read_json_records(spark, str(p), CI_RUNS)
    assert typed.schema == CI_RUNS and typed.count() == 2
    assert typed.where("id = 5").first().repository.full_name == "o/r"
    sniffed = lake.read_json_records(spark, str(p))
    assert "extra" in sniffed.columns


def test_replacement_that_stopped_between_its_renames(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(3).write.parquet(p)
    spark.range(7).write.parquet(p + ".__new_x")
    lake.rename(spark, p, p + ".__old_x")  # the run stops here
    assert lake.is_table(spark, p) and lake.read_lake_table(spark, p).count() == 7
    lake.delete(spark, p + ".__old_x")
    # an unfinished new directory: the old table comes back
    q = str(tmp_path / "q")
    spark.range(3).write.parquet(q + ".__old_y")
    (tmp_path / "q.__new_y").mkdir()
    assert lake.read_or_empty(spark, q, EXTENSION_DOWNLOADS).count() == 3
    assert not lake.is_table(spark, str(tmp_path / "none"))


def test_compaction_keeps_partitions_and_order(spark, tmp_path):
    p = str(tmp_path / "parts")
    df = spark.range(300).selectExpr("id", "id % 3 as a", "cast(id % 2 as string) as b")
    for _ in range(2):
        df.repartition(4).write.mode("append").partitionBy("a", "b").parquet(p)
    assert lake.partition_columns(spark, p) == ["a", "b"]
    lake.compact_table(spark, p)
    files = list((tmp_path / "parts").glob("a=*/b=*/*.parquet"))
    assert len(files) == 6 and not list((tmp_path / "parts").glob("*.parquet"))
    spark.range(5).selectExpr("id", "9L as a", "'9' as b").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("a", "b").parquet(p)
    assert spark.read.parquet(p).count() == 605
    q = str(tmp_path / "ordered")
    spark.range(1000).selectExpr("id * 7 % 1000 as ts").repartition(8).write.parquet(q)
    lake.compact_table(spark, q, target_file_bytes=2000, order_by=["ts"])
    by_file = spark.read.parquet(q).groupBy(F.input_file_name()).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    spans = sorted((r.lo, r.hi) for r in by_file.collect())
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_sources_by_specification(spark, tmp_path):
    from metricslake.sources.source_sets import generate_sources, specs_from_records

    lake_root, out = str(tmp_path / "lake"), str(tmp_path / "out")
    spark.range(4).write.parquet(f"{lake_root}/runs")
    specs = specs_from_records([
        {"name": "ci", "tables": ["runs", "jobs"], "derived": ["evens", "nothing"]},
        {"name": "other", "tables": ["runs"]},
    ])
    definitions = {"evens": lambda s, root: s.read.parquet(f"{root}/runs").where("id % 2 = 0")}
    status = generate_sources(spark, specs, lake_root, out, definitions)
    assert status["ci"] == {"runs": "copied", "jobs": "missing", "evens": "materialized", "nothing": "undefined"}
    assert spark.read.parquet(f"{out}/ci/evens").count() == 2 and spark.read.parquet(f"{out}/other/runs").count() == 4
    assert list(generate_sources(spark, specs, lake_root, out, definitions, only=["other"])) == ["other"]
    with pytest.raises(ValueError):
        generate_sources(spark, specs, lake_root, out, definitions, only=["unknown"])


@pytest.mark.parametrize("step", range(5))
def test_a_stop_at_every_step_leaves_old_or_new(spark, tmp_path, monkeypatch, step):
    """Stops before the write, either rename or the cleanup; a leftover of an earlier stop lies beside."""
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    spark.range(111).write.parquet(f"{path}.__new_zzz")
    spark.range(99).write.parquet(f"{path}.__old_aaa")
    moves, real_rename, real_delete = [], lake.rename, lake.delete

    def stop_at(n):
        if len(moves) == n:
            raise KeyboardInterrupt
        moves.append(n)

    def rename(s, src, dst):
        stop_at(step - 1)
        real_rename(s, src, dst)

    def delete(s, p):
        stop_at(step - 1)
        real_delete(s, p)

    def write():
        if step == 0:
            raise KeyboardInterrupt
        lake.replace_table(spark, path, spark.range(5))

    with monkeypatch.context() as m:
        m.setattr(lake, "rename", rename)
        m.setattr(lake, "delete", delete)
        with pytest.raises(KeyboardInterrupt):
            write()
    assert lake.read_lake_table(spark, path).count() == (3 if step < 2 else 5)
    lake.replace_table(spark, path, spark.range(7))
    assert lake.read_lake_table(spark, path).count() == 7
    assert [p.name for p in tmp_path.iterdir()] == ["t"]  # nothing is left beside it


def test_a_reader_may_finish_the_swap_first(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path / "t"), lake.rename
    spark.range(3).write.parquet(path)

    def rename(s, src, dst):
        real(s, src, dst)
        if src == path:
            lake.recover(spark, path)  # a reader between the two renames

    monkeypatch.setattr(lake, "rename", rename)
    lake.replace_table(spark, path, spark.range(5))
    assert spark.read.parquet(path).count() == 5


def test_a_dropped_table_stays_away(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    spark.range(3).write.parquet(f"{path}.__old_aaa")
    lake.drop_table(spark, path)
    assert not lake.is_table(spark, path)
    spark.range(4).write.parquet(f"{path}.__new_bbb")  # a write that never got to its swap
    assert not lake.is_table(spark, path)


def test_change_log(spark, tmp_path):
    path, form = str(tmp_path / "log"), "id long, v string"
    states = [[(1, "A"), (2, "A"), (3, "A"), (None, "n")], [(1, "B"), (2, "B"), (4, "A"), (5, "x")], [(1, "C"), (2, "A"), (4, "A")], [(1, "B"), (2, "A"), (4, "Z"), (3, "A")]]
    frames = [spark.createDataFrame(s, form) for s in states]
    for k in (1, 2, 3, 3):
        change_log.record(spark, path, frames[k - 1], frames[k], ["id"], k)
    log = change_log.read(spark, path, 1, 3)
    assert log.count() == 18
    # 1 passed through B and came back to it, 2 and 3 are as before: only what is new and stayed
    assert [tuple(r) for r in change_log.new_values(log).collect()] == [(4, "Z")]
    net = sorted(change_log.net_changes(log, ["id"]).collect(), key=str)
    assert [(r.id, r.v, r.change_type) for r in net] == [(1, "B", "update"), (4, "Z", "insert"), (None, "n", "delete")]
    assert [tuple(r) for r in change_log.new_values(change_log.read(spark, path, 3, 3)).collect()] == [(1, "B"), (3, "A"), (4, "Z")]
    # a column that comes later
    wider = spark.createDataFrame([(1, "B", 7)], "id long, v string, w int")
    change_log.record(spark, path, frames[3], wider, ["id"], 4)
    assert change_log.new_values(change_log.read(spark, path, 4, 4)).first().w == 7
    assert change_log.new_values(change_log.read(spark, path, 8, 9)).collect() == []


def test_profile_from_statistics(spark, tmp_path):
    """Equal to the scan's, whatever the types, NULLs, NaNs and files without rows or values."""
    p = str(tmp_path / "t")
    rows = [(k, None if k % 3 else k, None, float("nan") if k == 4 else k / 2, f"s{k}", [k], k % 2) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, some int, none int, part double, name string, list array<int>, half int")
    df = df.withColumn("day", F.expr("date_add(date'2024-01-01', cast(id as int))")).withColumn("at", F.col("day").cast("timestamp_ntz"))
    for state in (df.repartition(3), df.where("id < 3").coalesce(1), df.limit(0)):
        state.write.mode("append").partitionBy("half").parquet(p)
    stored = spark.read.parquet(p)
    plain = {r.column_name: r for r in changes.column_profile(stored, cast_to="string", columns=[c for c in stored.columns if c != "list"]).collect()}
    told = {r.column_name: r for r in changes.stored_profile(spark, p, columns=list(plain)).collect()}
    assert told == plain and (told["id"].max_value, told["some"].null_count, told["part"].contains_nan) == ("39", 28, True)
    assert "list" in {r.column_name for r in changes.stored_profile(spark, p, ["list", "id"]).collect()}
    empty = str(tmp_path / "empty")
    df.limit(0).write.parquet(empty)
    assert {(r.min_value, r.null_count) for r in changes.stored_profile(spark, empty).collect()} == {(None, 0)}


def test_appending_keeps_partitions(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, kind string")
    df.write.partitionBy("kind").parquet(p)
    lake.append_records(spark, p, spark.createDataFrame([("a", 3), ("c", 4)], "kind string, id int"))
    assert lake.partition_columns(spark, p) == ["kind"]
    assert sorted(tuple(r) for r in spark.read.parquet(p).select("id", "kind").collect()) == [(1, "a"), (2, "b"), (3, "a"), (4, "c")]


def test_leftovers_are_taken_from_the_stored_table(spark, monkeypatch):
    """The jobs are joined once, for the table itself; no leftover computes them again."""
    plans, create = [], lake.create_table_as

    def seen(spark, path, df, **how):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return create(spark, path, df, **how)

    monkeypatch.setattr(lake, "create_table_as", seen)
    table = QUERIES["read_lake_table"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 4 and sum("Join" in p for p in plans) == 1
    assert table.count() == model_table(spark, "/root/testdata/sf0.001", "ci_jobs").count()
