"""Operator 8: round trip, ranges, odd pages, and public readers of gzip."""

import gzip
import io
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metricslake.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, hash int"


def source(data):
    return warc.Source(pa.BufferReader(data))


@pytest.fixture
def small_fetch(monkeypatch):
    monkeypatch.setattr(warc, "FETCH_BYTES", 41)


def test_every_record_has_one_owner(small_fetch):
    rng = random.Random(4)
    made = [warc.record(i, f"http://x/{i}", os.urandom(rng.randrange(300)), None, False) for i in range(40)]
    data = b"".join(made)
    whole = [gzip.decompress(m) for m in made]
    for split in (1, 7, 50, 333, 10**6):
        got = [r for start in range(0, len(data), split) for r in warc.records(source(data), start, start + split)]
        assert got == whole
    assert gzip.decompress(data) == b"".join(whole)  # the archive is an ordinary gzip file


def test_false_magic_and_cut_members(small_fetch):
    one, two = warc.record(1, None, b"a", None, False), warc.record(2, None, b"b", 1, True)
    other = gzip.compress(b"no record")
    data = warc.MAGIC + b"junk" + one + other + warc.MAGIC + two + one[:-9]
    got = [warc.parse(r) for r in warc.records(source(data), 0, len(data), strict=False)]
    assert [(g["page_id"], g["record_type"], g["refers_to"], g["payload_bytes"]) for g in got] == [(1, "response", None, 1), (2, "revisit", 1, 1)]


@pytest.mark.parametrize("split", [1, 60, 200, 10**6])
def test_lost_records_are_found(small_fetch, split):
    """A member that is cut off or damaged is an error in some range, whatever the ranges."""
    made = [warc.record(i, None, os.urandom(100), None, False) for i in range(6)]
    whole = b"".join(made)
    third = len(made[0]) + len(made[1])
    broken = [whole[: third + 40] + b"\x00" * 30 + whole[third + 70 :], whole[:third] + b"\x00" + whole[third + 1 :], whole[:-9], b"x" + whole, whole + b"junk"]
    for data in [*broken, whole]:
        read = lambda d=data: [r for at in range(0, len(d), split) for r in warc.records(source(d), at, at + split)]
        if data is whole:
            assert len(read()) == 6
            continue
        with pytest.raises(ValueError):
            read()


def test_a_file_of_another_size_is_an_error(spark):
    manifest = warc.write(spark.createDataFrame([(k, "u", "text", "", 1) for k in range(5)], SCHEMA))
    with pytest.raises(Exception, match="instead of"):
        warc.read(manifest.withColumn("bytes", F.col("bytes") + 1)).collect()


def test_damage_is_found():
    packed = gzip.decompress(warc.record(1, None, b"abc", None, False)).replace(b"abc", b"abd")
    with pytest.raises(ValueError):
        warc.parse(packed)


def test_round_trip(spark):
    pages = [
        (5, "http://a/ b\r\nx", "same", "", 1), (3, "http://é", "same", "", 1), (9, None, "same", "", 1), (4, "u", None, "", 1), (6, "u", "", "", 1),
        (7, "u", "\r\n\r\nü\u0000" * 10, "", 1), (8, "u", "x" * 300_000, "", 1), (8, "u", "x" * 300_000, "", 1), (None, "u", "same", "", 1), (None, "u", "alone", "", 1),
    ]
    df = spark.createDataFrame(pages, SCHEMA)
    manifest = warc.write(df)
    assert sum(r.records for r in manifest.collect()) == len(pages)
    for split in (100, warc.SPLIT_BYTES):
        rows = warc.read(manifest, split_bytes=split).collect()
        assert sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes) for r in rows) == sorted(
            (str(i), kind, str(ref), len((h or "").encode()))
            for (i, _, h, _, _), kind, ref in zip(
                pages,
                ["revisit", "response", "revisit", "response", "revisit", "response", "response", "response", "revisit", "response"],
                [3, None, 3, None, 4, None, None, None, 3, None],
            )
        )
        by = {r.page_id: r for r in rows if r.page_id is not None}
        assert by[7].payload.decode() == pages[5][2] and by[3].payload == b"same" and by[9].payload is None
        assert all(r.payload_digest == warc.digest((h or "").encode()) for i, _, h, _, _ in pages for r in rows if i is not None and r.page_id == i)
        assert by[5].url == "http://a/%20b%0D%0Ax" and by[9].url is None
    assert warc.read(warc.write(df.limit(0))).collect() == []


def test_files_are_gzip(spark):
    manifest = warc.write(spark.createDataFrame([(1, "u", "text", "", 1)], SCHEMA)).collect()
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(manifest[0].path)
    raw = system.open_input_file(name).read()
    assert gzip.GzipFile(fileobj=io.BytesIO(raw)).read().endswith(b"\r\n\r\ntext\r\n\r\n")
