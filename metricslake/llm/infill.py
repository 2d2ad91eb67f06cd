"""Fill-in-the-middle documents, cut at unit ends found in 64-bit words (operator 13).

The UTF-8 bytes of a batch of texts are viewed as 64-bit words. Arithmetic on a whole word
marks the bytes that end a unit (a line feed, or the last byte of a code point), a population
count of each word and their running sum tell how many marks stand before it, and the k-th
mark is found by a binary search of the running sum and a select inside one word: prefix sums
of its eight mark bytes by one multiplication. Texts are then cut by byte places alone.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricslake.llm.common import lean

#: Texts whose bytes are viewed at once, a bound on memory (one longer text comes by itself).
SLICE_BYTES = 16 << 20

ONES = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)
LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)


def equal_bytes(words: np.ndarray, byte: int) -> np.ndarray:
    """The high bit of each byte that equals ``byte``; no carry leaves a byte."""
    x = words ^ (ONES * np.uint64(byte))
    return ~(((x & LOW7) + LOW7) | x | LOW7)


def first_bytes(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that begins a code point (that is no continuation byte 10xxxxxx)."""
    return ~(words & ~(words << np.uint64(1))) & HIGH


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Number of marked bytes before each byte place."""
        word, byte = place >> 3, (place & 7).astype(np.uint64)
        inside = np.append(self.marks, np.uint64(0))[word] & ((np.uint64(1) << (byte << np.uint64(3))) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte place of each k-th mark, k from 0."""
        word = np.searchsorted(self.before, k, "right") - 1
        sums = (self.marks[word] >> np.uint64(7)) * ONES  # byte j: marks in bytes 0 to j
        upto = (sums[:, None] >> (np.arange(8, dtype=np.uint64) << np.uint64(3))) & np.uint64(0xFF)
        return (word << 3) + (upto <= (k - self.before[word]).astype(np.uint64)[:, None]).sum(1)


@dataclass(frozen=True)
class Form:
    """How documents are rewritten. Sentinels stand before prefix, suffix and middle; of 100
    documents ``rate`` are rewritten and of 100 of those ``spm`` give the suffix first."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 100
    spm: int = 50
    seed: int = 7
    unit: str = "line"

    def __post_init__(self):
        marks = self.sentinels
        overlaps = any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)) + 1) if a != b or k < len(a))
        if len(set(marks)) < 3 or not all(marks) or overlaps or any(a in b for a in marks for b in marks if a != b):
            raise ValueError("sentinels have to be three texts of which none overlaps another")
        if self.unit not in ("line", "char"):
            raise ValueError(f"unknown unit {self.unit!r}")

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def cuts(data: np.ndarray, offsets: np.ndarray, one: np.ndarray, two: np.ndarray, unit: str):
    """Where texts are cut into prefix, middle and suffix.

    ``data`` holds the bytes of all texts on end, ``offsets`` where they begin and end; ``one`` and
    ``two`` are hashes. Returns the number of units of each text, the byte places of both
    cuts, and the marks of first bytes, which count code points.
    """
    padded = np.zeros(-(-len(data) // 8) * 8, np.uint8)
    padded[: len(data)] = data
    words = padded.view("<u8")
    starts = Marks(first_bytes(words))
    begin, end = offsets[:-1], offsets[1:]
    if unit == "line":
        ends = Marks(equal_bytes(words, 0x0A))
        before, full = ends.rank(begin), ends.rank(end)
        some = end > begin
        open_end = np.zeros(len(begin), bool)
        open_end[some] = data[end[some] - 1] != 0x0A  # the last line has no line feed
        n = full - before + open_end
    else:
        before, full = starts.rank(begin), starts.rank(end)
        n = full - before
    low, high = np.sort(np.stack([one % (n + 1), two % (n + 1)]), axis=0)

    def after(k):
        """The byte place after the first k units of each text."""
        place = np.where(k == 0, begin, end)
        inner = (k > 0) & (k < n)
        if unit == "line":
            place[inner] = ends.select(before[inner] + k[inner] - 1) + 1
        else:
            place[inner] = starts.select(before[inner] + k[inner])
        return place

    return n, after(low), after(high), starts


def restore(output: bytes | str, form: str, how: Form) -> bytes | str:
    """The text from which ``output`` was made."""
    if form == "plain":
        return output
    marks = how.sentinels if isinstance(output, str) else [m.encode() for m in how.sentinels]
    prefix, suffix, middle = marks
    if form == "psm":
        one, rest = output[len(prefix) :].split(suffix, 1)
        three, two = rest.split(middle, 1)
    else:
        three, rest = output[len(suffix) :].split(prefix, 1)
        one, two = rest.split(middle, 1)
    return one + two + three


def rewritten(docs: DataFrame, how: Form | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text with its middle moved to the end.

    Returns one row for each row of ``docs``: ``id_col``, ``n`` (units), ``form`` (plain, psm or
    spm), ``prefix_chars`` and ``middle_chars`` (code points; null if plain) and ``output``. A text that
    is null or empty or holds a sentinel stays plain, as does a share of 100 - ``rate``. The cuts
    follow from the seed and the id; rows that repeat an id have the same hashes, rows without an id
    those of an empty id. Other columns are not read.
    """
    how = how or Form()
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    hashes = [F.conv(F.substring(name, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    stays = (text == "") | (hashes[2] % 100 >= how.rate)
    for mark in how.sentinels:
        stays |= text.contains(mark)
    form = F.when(stays, "plain").when(hashes[3] % 100 < how.spm, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col), text.cast("binary").alias("text"), hashes[0].alias("one"), hashes[1].alias("two"), form.alias("form"))
    prefix, suffix, middle = (m.encode() for m in how.sentinels)

    def part(batch):
        texts = batch.column(1)
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        forms = batch.column(4).to_pylist()
        n, low, high, starts = cuts(data, offsets, batch.column(2).to_numpy(), batch.column(3).to_numpy(), how.unit)
        chars = np.stack([starts.rank(low) - starts.rank(offsets[:-1]), starts.rank(high) - starts.rank(low)])
        whole, output = data.tobytes(), []
        for form, begin, one, two, end in zip(forms, offsets[:-1].tolist(), low.tolist(), high.tolist(), offsets[1:].tolist()):
            if form == "plain":
                output.append(whole[begin:end])
            elif form == "psm":
                output.append(b"".join((prefix, whole[begin:one], suffix, whole[two:end], middle, whole[one:two])))
            else:
                output.append(b"".join((suffix, whole[two:end], prefix, whole[begin:one], middle, whole[one:two])))
        plain = np.array([f == "plain" for f in forms], bool)
        counts = [pa.array(c.astype(np.int64), pa.int64(), mask=plain) for c in chars]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), batch.column(4), *counts, pa.array(output, pa.binary())],
            names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"],
        )

    def run(batches):
        for batch in batches:
            begin = 0
            sizes = np.diff(np.frombuffer(batch.column(1).buffers()[1], np.int32, batch.num_rows + 1, 4 * batch.column(1).offset)) if batch.num_rows else []
            ends = np.cumsum(sizes, dtype=np.int64)
            while begin < batch.num_rows:
                before = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
                yield part(batch.slice(begin, end - begin))
                begin = end

    out = rows.mapInArrow(lean(run), f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(rows: DataFrame, how: Form | None = None) -> DataFrame:
    """``rows`` of ``rewritten`` with ``restored``, the text rebuilt from output and form alone."""
    how = how or Form()
    kept = [c for c in rows.columns if c != "restored"]
    at, form_at = kept.index("output"), kept.index("form")

    def run(batches):
        for batch in batches:
            output = batch.column(at).cast(pa.binary()).to_pylist()
            text = [restore_bytes(o, f) for o, f in zip(output, batch.column(form_at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.binary()).cast(pa.string())], names=[*kept, "restored"])

    def restore_bytes(output, form):
        return None if output is None else restore(output, form, how)

    return rows.select(*kept).mapInArrow(lean(run), rows.select(*kept).schema.add("restored", "string"))


def digests(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result columns of the query from rows with ``output`` and ``restored``."""
    hashed = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return rows.select(id_col, "n", "form", "prefix_chars", "middle_chars", *hashed)


def oracle(how: Form | None = None) -> str:
    """The query's rows (lines as units) in DuckDB SQL."""
    how = how or Form()
    p, s, m = how.sentinels
    hashes = ", ".join(f"('0x' || substr(hash, {8 * k + 1}, 8))::bigint as h{k + 1}" for k in range(4))
    return rf"""
with doc as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as lines,
    sha256('{how.seed}:' || coalesce(doc_id::varchar, '')) as hash from documents),
cut as (
  select *, len(lines) as n, {hashes} from doc),
part as (
  select doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b, lines,
    case when text = '' or contains(text, '{p}') or contains(text, '{s}') or contains(text, '{m}') or h3 % 100 >= {how.rate} then 'plain'
      when h4 % 100 < {how.spm} then 'spm' else 'psm' end as form from cut),
piece as (
  select *, array_to_string(lines[1:a], '') as pre, array_to_string(lines[a + 1:b], '') as mid, array_to_string(lines[b + 1:], '') as suf from part)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then length(pre) end::bigint as prefix_chars,
  case when form <> 'plain' then length(mid) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '{p}' || pre || '{s}' || suf || '{m}' || mid
    else '{s}' || suf || '{p}' || pre || '{m}' || mid end) as output_sha256,
  sha256(pre || mid || suf) as restored_sha256
from piece
"""
