"""Weekly download files: path rules, unpivot, rejects and the period key."""

import datetime as dt
import json

from pyspark.sql import functions as F

from metricslake.schemas import EXTENSION_DOWNLOADS
from metricslake.sources import download_files as dl


def _write(root, year, week, obj):
    d = root / dl.STATS_DIR / str(year)
    d.mkdir(parents=True, exist_ok=True)
    (d / f"{week}.json").write_text(obj if isinstance(obj, str) else json.dumps(obj))


def test_read_download_stats(spark, tmp_path):
    core, community = tmp_path / "core", tmp_path / "community"
    _write(core, 2024, 1, {"_last_update": "2024-01-08 10:00:00", "httpfs": 100, "json": 50})
    _write(core, 2024, 2, {"json": 7})  # missing _last_update
    _write(core, 2024, 0, {"_last_update": "2024-01-08 10:00:00", "x": 1})  # week 0
    _write(core, 2024, 54, {"_last_update": "2024-01-08 10:00:00", "x": 1})  # week 54
    _write(core, "abcd", 3, {"_last_update": "2024-01-08 10:00:00", "x": 1})  # year not digits
    _write(community, 2024, 1, {"_last_update": "2024-01-09 00:00:00", "ext": 3})
    out = dl.read_download_stats(spark, {"core": str(core), "community": str(community)})
    rows = sorted(tuple(r) for r in out.valid.select("year", "week", "extension_name", "downloads", "repository").collect())
    assert rows == [(2024, 1, "ext", 3, "community"), (2024, 1, "httpfs", 100, "core"), (2024, 1, "json", 50, "core")]
    reasons = sorted(r.reason for r in out.rejected.collect())
    assert reasons == ["invalid period path"] * 3 + ["missing _last_update"]
    assert str(out.valid.where("extension_name = 'ext'").first().last_update) == "2024-01-09 00:00:00"


def test_period_key_quirk(spark):
    stored = spark.createDataFrame([(2024, 1, "core")], "year int, week int, repository string")
    batch = spark.createDataFrame(
        [(2024, 1, "core"), (2024, 1, "community"), (2024, 2, "core")], "year int, week int, repository string"
    )
    fresh = sorted(tuple(r) for r in dl.skip_stored_periods(batch, stored).collect())
    assert fresh == [(2024, 1, "community"), (2024, 2, "core")]
    legacy = sorted(tuple(r) for r in dl.skip_stored_periods(batch, stored, legacy_key=True).collect())
    assert legacy == [(2024, 2, "core")]  # the late community file of week 1 is never loaded


def test_round_trip_from_table(spark):
    d = spark.createDataFrame(
        [(2024, 5, "a", 3, "core"), (2024, 5, "b", 4, "core")],
        "year int, week int, extension_name string, downloads long, repository string",
    ).selectExpr("*", "timestamp_ntz'2024-02-01 00:00:00' as last_update")
    files = dl.download_files_from_table(d)
    assert files.first().file_path == "lake/core/download-stats-weekly/2024/5.json"
    back = dl.unpivot_download_counts(dl.parse_period_path(files).valid).valid
    assert sorted((r.extension_name, r.downloads) for r in back.collect()) == [("a", 3), ("b", 4)]


def test_files_of_stored_periods_are_not_opened(spark, tmp_path):
    rows = [(2023 + y, w, e, 5, None, r) for y in range(2) for w in range(1, 5) for e in ("a", "b") for r in ("core", "community")]
    downloads = spark.createDataFrame(rows, EXTENSION_DOWNLOADS).withColumn("last_update", F.lit(dt.datetime(2024, 2, 1)).cast("timestamp_ntz"))
    plain = {r: str(tmp_path / r) for r in ("core", "community")}
    assert dl.write_stat_files(downloads, plain) == 16
    stored = downloads.where("repository = 'core' and year = 2023 or repository = 'community' and week < 4")
    fresh = dl.read_new_files(spark, plain, stored)
    assert len(fresh.inputFiles()) == 6
    assert sorted(dl.read_download_stats(spark, plain, stored).valid.collect()) == sorted(downloads.exceptAll(stored).collect())
    (tmp_path / "core" / dl.STATS_DIR / "2023" / "x{1}.json").write_text("{}")  # told by no period: read and rejected
    got = dl.read_download_stats(spark, plain, stored)
    assert got.rejected.count() == 1 and got.valid.count() == 12
    assert dl.read_new_files(spark, plain, downloads).count() == 1
    assert len(dl.read_new_files(spark, plain, stored, legacy_key=True).inputFiles()) == 2 + 1
