"""WARC archives: a writer, and a reader that splits files by byte ranges (operator 8).

Each record is a gzip member of its own. A task of the reader gets a byte range, looks for
the gzip magic in it and validates each candidate by decoding the member's first bytes as a
record header. It owns the records whose member starts inside its range, and reads past the
end of the range to finish the last one; bytes before the first start belong to the task of
an earlier range.

Tasks write archives under names of their own and return them in a manifest that Spark
writes; a file that a lost or repeated attempt leaves behind is in no manifest and so is
not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricslake.llm.common import lean, new_path, written

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
#: Archives are closed beyond this size; ranges of the reader have this size.
ARCHIVE_BYTES = 256 << 20
SPLIT_BYTES = 16 << 20
#: Bytes fetched at a time.
FETCH_BYTES = 1 << 20
#: Payloads of at least so many bytes are written once; later equal ones refer to the first.
REVISIT_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member; a revisit keeps the HTTP head, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([] if url is None else ["WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)]),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{'' if refers_to is None else refers_to}>"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, wbits=31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _number(value: str | None) -> int | None:
    digits = (value or "").strip("<>").removeprefix(ID)
    return int(digits) if digits else None


def parse(raw: bytes) -> dict:
    """Fields of a decoded record; a response whose payload does not have its digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and digest(payload) != told:
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": _number(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload": payload if kind == "response" else None,
        "payload_bytes": int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1]),
        "payload_digest": told,
        "record_type": kind,
        "refers_to": _number(fields.get("WARC-Refers-To")),
    }


class Source:
    """Bytes of a file by place, fetched in pieces."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.begin, self.piece = 0, b""

    def at(self, place: int) -> bytes:
        """Some bytes from ``place`` on, at least 3 unless the file ends."""
        if not self.begin <= place <= self.begin + len(self.piece) - len(MAGIC):
            self.begin = place
            self.piece = self.file.read_at(min(FETCH_BYTES, self.size - place), place) if place < self.size else b""
        return self.piece[place - self.begin :]


def member(source: Source, place: int) -> tuple[bytes, int] | None:
    """The record whose member starts at ``place`` and where the member ends; None if there is none."""
    unpacker, out = zlib.decompressobj(31), bytearray()
    while not unpacker.eof:
        data = source.at(place)[: 64 << 10]
        if not data:
            return None  # cut off
        try:
            out += unpacker.decompress(data)
        except zlib.error:
            return None
        if not out.startswith(VERSION[: len(out)]):
            return None
        place += len(data) - len(unpacker.unused_data)
    return (bytes(out), place) if out.startswith(VERSION) and b"\r\n\r\n" in out else None


def records(source: Source, start: int, end: int, strict: bool = True) -> Iterator[bytes]:
    """Records whose member starts in ``[start, end)``.

    If ``strict``, members follow each other from the first byte to the last: a record's end that
    is neither the end of the file nor a member's start is an error, whoever owns that start, so a
    member that is cut off or damaged never goes unseen.
    """
    place, follows = start, start == 0
    while place < min(end, source.size):
        data = source.at(place)
        hit = 0 if strict and follows else data.find(MAGIC)
        if hit < 0:
            if place + len(data) >= source.size:
                return
            place += len(data) - len(MAGIC) + 1
            continue
        place += hit
        if place >= end:
            return
        found = member(source, place)
        if found:
            yield found[0]
            place, follows = found[1], True
        elif strict and follows:
            raise ValueError(f"no whole record at byte {place}")
        else:
            place += 1
    if strict and follows and place < source.size and member(source, place) is None:
        raise ValueError(f"no whole record at byte {place}")


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) and return the manifest
    ``path``, ``bytes``, ``records``, a table that Spark has written.

    A null html is an empty payload. Of records with equal payloads that with the smallest
    page_id is a response and the others are revisits that refer to it; rows that repeat the
    smallest page_id are responses too. A null page_id counts as the largest; if there is no
    other, all are responses. Other columns are not read, so their names may clash.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "archives")
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("hash", F.sha2("payload", 256))
    firsts = rows.groupBy("hash").agg(F.min("page_id").alias("first"))
    typed = rows.join(firsts, "hash").select(
        "page_id",
        "url",
        "payload",
        F.col("first").cast("long").alias("first"),
        (~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= REVISIT_BYTES)).alias("revisit"),
    )

    def run(batches):
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        sink, name, size, count = None, "", 0, 0

        def told():
            sink.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [count]})

        for batch in batches:
            for page_id, url, payload, first, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = system.open_output_stream(f"{root}/{name}", compression=None)
                data = record(page_id, url, payload, first, revisit)
                sink.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    yield told()
                    sink = None
        if sink is not None:
            yield told()

    return written(typed.mapInArrow(lean(run), "path string, bytes long, records long"), "manifest")


SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])


def read(manifest: DataFrame, payloads: bool = True, split_bytes: int = SPLIT_BYTES, rows: int = 200, strict: bool = True) -> DataFrame:
    """The records of the archives in ``manifest`` (``path``, ``bytes``), one row each.

    ``payload`` is null for revisits, and for all records if ``payloads`` is false. A file of another
    size than the manifest tells, or with bytes that are no whole record, is an error; if not
    ``strict``, such bytes are passed over.
    """
    ranges = manifest.filter(F.col("bytes") > 0).select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    )
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_file(name) as file:
                    waiting, source = [], Source(file)
                    if strict and source.size != size:
                        raise ValueError(f"{path} has {source.size} bytes instead of {size}")
                    for raw in records(source, start, min(start + split_bytes, size), strict):
                        fields = parse(raw)
                        waiting.append(fields if payloads else fields | {"payload": None})
                        if len(waiting) == rows:
                            yield pa.RecordBatch.from_pylist(waiting, ARROW)
                            waiting = []
                    if waiting:
                        yield pa.RecordBatch.from_pylist(waiting, ARROW)

    return ranges.repartition(parts).mapInArrow(lean(run), SCHEMA)


def oracle() -> str:
    """The query's rows in DuckDB SQL; base 32 from five hexadecimal digits at a time."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [f"('0x' || substr(hash, {5 * g + 1}, 5))::bigint" for g in range(8)]
    base32 = " || ".join(f"substr('{letters}', (({v} >> {s}) & 31)::int + 1, 1)" for v in groups for s in (15, 10, 5, 0))
    return f"""
with page as (select page_id, encode(coalesce(html, '')) as payload, sha1(coalesce(html, '')) as hash from pages),
first as (select *, min(page_id) over (partition by payload) as first_id from page)
select page_id, octet_length(payload)::bigint as payload_bytes, {base32} as payload_digest,
  case when page_id is not distinct from first_id then 'response' else 'revisit' end as record_type,
  case when page_id is not distinct from first_id then null else first_id end as refers_to
from first
"""
