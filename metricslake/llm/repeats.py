"""Removal of repeated passages with longest-previous-factor arrays (operator 9).

A byte is removed if a string of LENGTH bytes that covers it also starts earlier: in a
document with a smaller id, or before in the same one. In suffix order the earlier matches
of a position are at its previous and next smaller positions; its longest previous factor
is the longer of the two common prefixes, each the smallest of those between neighbours on
the way (:func:`previous_factors`). Bytes under a factor of LENGTH go, so suffixes are compared
up to LENGTH bytes.

The corpus has no suffix array in one place. Every string of LENGTH bytes is represented by
the first of its PIECE-byte strings with the smallest hash, whose choice depends on the
string's bytes alone, so equal strings have equal representatives. Consecutive strings that
are represented at the same place form a run. A run whose representative occurs nowhere
else holds no repeat. The others meet by representative with their own bytes, and the
factor array is built over the strings of the runs that meet.

A representative may be very common. Its runs are dealt into chunks by document, and of
strings that are first in their chunk the first over all chunks is found by their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricslake.llm.common import drop_written, lean, release, written

#: Shortest repeat, and the strings that represent it.
LENGTH, PIECE = 100, 32
#: More than a run has strings; its place is its first string's offset times RUN plus the others' number.
RUN = 128
#: Runs of one representative that a task gets together.
CHUNK_RUNS = 512
#: Bytes hashed and runs compared at a time (bounds on memory).
SEGMENT_BYTES = 1 << 21
BATCH_RUNS = 4096
#: Bits for a place in a segment.
PLACE_BITS = np.uint64(22)
#: Ids are smaller; texts without an id of their own have places from here on, by a hash of the text.
LAST_ID = 2**62
SEED = 9


def byte_codes() -> np.ndarray:
    """An odd 64-bit number for each byte."""
    return np.random.default_rng(SEED).integers(0, 2**63, 256, dtype=np.uint64) | np.uint64(1)


CODES = byte_codes()


def hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the PIECE bytes that start at each place, by doubling."""
    h, size, power = CODES[data], 1, 0x9E3779B97F4A7C15
    while size < PIECE:
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power % 2**64, 2 * size
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def representatives(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each string of LENGTH bytes the place and the hash of its representative.

    Places are compared after the leading bits of the hashes, so of equal ones the first wins.
    """
    own, size, window = hashes(data), 1, LENGTH - PIECE + 1
    low = own >> PLACE_BITS << PLACE_BITS | np.arange(len(own), dtype=np.uint64)
    n = len(low) - window + 1
    while 2 * size <= window:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    place = (np.minimum(low[:n], low[window - size : window - size + n]) & (np.uint64(1) << PLACE_BITS) - np.uint64(1)).astype(np.int64)
    return place, own[place]


def runs(texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text the representatives and the places of its runs."""
    found = [([], []) for _ in texts]
    pieces = [(k, at, t[at : at + SEGMENT_BYTES + LENGTH - 1]) for k, t in enumerate(texts) for at in range(0, len(t) - LENGTH + 1, SEGMENT_BYTES)]
    while pieces:
        taken, size = 0, 0
        while taken < len(pieces) and (taken == 0 or size + len(pieces[taken][2]) <= SEGMENT_BYTES + LENGTH):
            size += len(pieces[taken][2])
            taken += 1
        part, pieces = pieces[:taken], pieces[taken:]
        place, own = representatives(np.frombuffer(b"".join(p for _, _, p in part), np.uint8))
        begin = 0
        for k, at, piece in part:
            strings = slice(begin, begin + len(piece) - LENGTH + 1)
            begin += len(piece)
            first = np.flatnonzero(np.diff(place[strings], prepend=-1))
            length = np.diff(np.append(first, strings.stop - strings.start))
            found[k][0].append(own[strings][first])
            found[k][1].append((first + at) * RUN + length - 1)
    none = np.zeros(0, np.int64)
    return (
        [np.concatenate(h).view(np.int64) if h else none for h, _ in found],
        [np.concatenate(p).astype(np.int64) if p else none for _, p in found],
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, places = runs([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()])
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, kind), pa.array(places, kind)], names=["doc", "keys", "places"])


def _with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that meet others, with their bytes, from documents and the runs to take from them."""
    for batch in batches:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        met = batch.column("met")
        number = np.diff(met.offsets.to_numpy())
        key, place, rows = (met.flatten().field(k).to_numpy() for k in range(3))
        start, end = place // RUN, place // RUN + place % RUN + LENGTH
        doc = np.repeat(batch.column("doc").to_numpy(), number)
        size = np.repeat(np.fromiter(map(len, texts), np.int64, len(texts)), number)
        chunks = -(-rows // CHUNK_RUNS)
        chunk = np.where(chunks > 1, (doc * np.int64(0x5851F42D4C957F2D) >> np.int64(33)) % chunks, 0)
        fits = end <= size  # texts whose hashes are equal may differ
        edges = np.concatenate([[0], np.cumsum(number)])
        data = [t[a:b] for k, t in enumerate(texts) for a, b in zip(start[edges[k] : edges[k + 1]].tolist(), end[edges[k] : edges[k + 1]].tolist())]
        columns = [pa.array(key), pa.array(chunk, pa.int32()), pa.array(chunks > 1), pa.array(doc), pa.array(start), pa.array(data, pa.binary())]
        out = pa.RecordBatch.from_arrays(columns, schema=WITH_BYTES).filter(pa.array(fits))
        for begin in range(0, out.num_rows, 4 * BATCH_RUNS):
            yield out.slice(begin, 4 * BATCH_RUNS)


WITH_BYTES = pa.schema([("key", pa.int64()), ("chunk", pa.int32()), ("several", pa.bool_()), ("doc", pa.int64()), ("start", pa.int64()), ("data", pa.binary())])


def string_hashes(joined: np.ndarray) -> np.ndarray:
    """A hash of the LENGTH bytes that start at each place, by doubling."""
    h, size, power = CODES[joined], 1, 0x9E3779B97F4A7C15
    out, done, left = None, 0, LENGTH
    while True:
        if left & 1:  # LENGTH as a sum of powers of two
            n = len(joined) - LENGTH + 1
            part = h[done : done + n]
            out = part if out is None else out * np.uint64(power) + part
            done += size
        left >>= 1
        if not left:
            return out
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power % 2**64, 2 * size


def common_prefixes(suffix: np.ndarray) -> np.ndarray:
    """Of each row of bytes (rows are sorted) the length of the prefix that it shares with the row before."""
    differ = suffix[1:] != suffix[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), suffix.shape[1])
    return np.concatenate([[0], shared]).astype(np.int16)


def smaller_before(position: np.ndarray, shared: np.ndarray, width: int) -> np.ndarray:
    """The prefix that each suffix shares with the nearest one before it, in suffix order, whose position
    in the text is smaller (0 without one).

    Minima over 1, 2, 4, ... neighbours are kept, of positions and of common prefixes; from the longest
    stretch to the shortest one, a suffix passes those without a smaller position.
    """
    n = len(position)
    low, least, size = [position], [shared], 1
    while 2 * size < n:
        for table in (low, least):
            last = table[-1]
            table.append(np.concatenate([last[:size], np.minimum(last[size:], last[:-size])]))
        size *= 2
    at, factor = np.arange(n), np.full(n, width, np.int16)
    for level in range(len(low) - 1, -1, -1):
        some = np.flatnonzero(at >= 1 << level)
        some = some[low[level][at[some] - 1] >= position[some]]
        factor[some] = np.minimum(factor[some], least[level][at[some]])
        at[some] -= 1 << level
    return np.where(at > 0, np.minimum(factor, shared[at]), 0)


def previous_factors(suffix: np.ndarray, position: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix: the longest prefix that also starts at a smaller position.

    ``suffix`` has sorted rows of bytes, of which factors are prefixes, and ``position`` their positions. In suffix
    order the earlier suffixes that share most stand at the previous and the next smaller position.
    """
    if not len(suffix):
        return np.zeros(0, np.int16)
    shared = common_prefixes(suffix)
    before = smaller_before(position, shared, suffix.shape[1])
    after = smaller_before(position[::-1], np.concatenate([shared[:1], shared[:0:-1]]), suffix.shape[1])[::-1]
    return np.maximum(before, after)


def factors(data: list[bytes], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings of LENGTH bytes of some runs, which are in text order: for each its run, its
    offset there, and whether its longest previous factor has LENGTH bytes.

    Strings whose hash is alone have no equal, so a shorter factor, and stay out of the suffix order.
    """
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    strings = sizes - LENGTH + 1
    run = np.repeat(np.arange(len(data)), strings)
    within = np.arange(len(run)) - np.repeat(np.cumsum(strings) - strings, strings)
    joined = np.frombuffer(b"".join(data), np.uint8)
    place = np.repeat(np.cumsum(sizes) - sizes, strings) + within
    code = string_hashes(joined)[place]
    ranked = np.sort(code)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    at = np.searchsorted(twice, code)
    at[at == len(twice)] = 0
    some = np.flatnonzero(twice[at] == code) if len(twice) else np.zeros(0, np.int64)
    repeated = np.zeros(len(run), bool)
    if len(some):
        suffix = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(joined, LENGTH)[place[some]])
        order = np.argsort(suffix.view(f"V{LENGTH}").ravel(), kind="stable")
        # positions in the text, by rank; a repeated row starts at the same position, not earlier
        at_doc, at_start = doc[run[some]], (start[run] + within)[some]
        position = np.cumsum((np.diff(at_doc, prepend=at_doc[0]) != 0) | (np.diff(at_start, prepend=at_start[0]) != 0))
        repeated[some[order]] = previous_factors(suffix[order], position[order]) >= LENGTH
    return run, within, repeated


FOUND = pa.schema([("doc", pa.int64()), ("from", pa.int64()), ("to", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated strings (``from``, ``to``), and hashes of strings to compare across chunks."""

    def of(table: pa.Table) -> pa.RecordBatch:
        table = table.sort_by([("doc", "ascending"), ("start", "ascending")])
        data = table.column("data").to_pylist()
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        doc, start = table.column("doc").to_numpy(), table.column("start").to_numpy()
        several = table.column("several").to_numpy(zero_copy_only=False)
        # of runs with equal bytes the first stands for all: every string of the others starts earlier there
        own: dict[bytes, int] = {}
        of_run = np.fromiter((own.setdefault(d, k) for k, d in enumerate(data)), np.int64, len(data))
        again = (doc != doc[of_run]) | (start != start[of_run])
        whole = np.flatnonzero(again)
        alone = np.flatnonzero(of_run == np.arange(len(data)))
        data, doc_all, start_all = [data[k] for k in alone.tolist()], doc, start
        doc, start, several = doc[alone], start[alone], several[alone]
        run, within, repeated = factors(data, doc, start)
        hit = np.flatnonzero(repeated)
        edge = np.concatenate([[True], (run[hit[1:]] != run[hit[:-1]]) | (within[hit[1:]] != within[hit[:-1]] + 1)]) if len(hit) else np.zeros(0, bool)
        begin, end = hit[edge], hit[np.append(np.flatnonzero(edge)[1:], len(hit)) - 1] if len(hit) else hit
        unsure = np.flatnonzero(several[run] & ~repeated)
        code = [xxhash.xxh128_intdigest(data[run[u]][within[u] : within[u] + LENGTH]) for u in unsure]
        none = [None] * (len(whole) + len(begin))
        columns = [
            np.concatenate([doc_all[whole], doc[run[begin]], doc[run[unsure]]]),
            np.concatenate([start_all[whole], start[run[begin]] + within[begin], start[run[unsure]] + within[unsure]]),
            np.concatenate([(start_all + sizes)[whole], start[run[end]] + within[end] + LENGTH, start[run[unsure]] + within[unsure] + LENGTH]),
            none + [(c >> 64) - 2**63 for c in code],
            none + [(c & 2**64 - 1) - 2**63 for c in code],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=FOUND)

    waiting, rows = [], 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= BATCH_RUNS:
            table = pa.Table.from_batches(waiting)
            key, chunk = table.column("key").to_numpy(), table.column("chunk").to_numpy()
            last = np.flatnonzero((key != key[-1]) | (chunk != chunk[-1]))
            whole = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            if whole:
                yield of(table.slice(0, whole))
                table = table.slice(whole)
            waiting, rows = table.to_batches(), table.num_rows
    if rows:
        yield of(pa.Table.from_batches(waiting))


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``text`` and ``doc``, the number that stands for the text: its id, or LAST_ID and more
    if it has none or a text of smaller hash has the same id. Equal texts of one id share a number.

    Ids with several texts are few (a table in the shared folder, so its size is known to the join).
    """
    code = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("_id"))
    several = rows.filter("_id is not null").groupBy("_id").agg(F.min(code).alias("_first"), F.max(code).alias("_last"))
    several = written(several.filter("_first < _last").drop("_last"), "several")
    last = F.lit(LAST_ID) + F.shiftrightunsigned(code, 2)
    own = F.when(F.col("_id").isNull() | (code > F.col("_first")), last).otherwise(F.col("_id"))
    return rows.join(several, "_id", "left").select(id_col, "text", own.alias("doc"))


def spans(docs: DataFrame) -> DataFrame:
    """``doc``, ``from``, ``to``: spans of bytes (they may overlap) whose strings start earlier too,
    from rows ``doc`` and ``text``."""
    spark = docs.sparkSession
    own = docs.select("doc", "text")
    known = written(own.filter(F.octet_length("text") >= LENGTH).mapInArrow(lean(_runs), "doc long, keys array<long>, places array<long>"), "runs")
    counts = known.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("rows"))
    counts = written(counts.filter("rows > 1"), "counts")
    release(spark)
    each = known.select("doc", F.explode(F.arrays_zip("keys", "places")).alias("run")).select("doc", F.col("run.keys").alias("key"), F.col("run.places").alias("place"))
    met = written(each.join(counts, "key").groupBy("doc").agg(F.collect_list(F.struct("key", "place", "rows")).alias("met")), "met")
    drop_written(spark, known, counts)
    del known, counts, each
    release(spark)

    form = "key long, chunk int, several boolean, doc long, start long, data binary"
    # written next to each other in a document, overlapping bytes take little room
    taken = written(own.join(met, "doc").mapInArrow(lean(_with_bytes), form), "bytes")
    drop_written(spark, met)
    release(spark)
    dealt = taken.repartition("key", "chunk").sortWithinPartitions("key", "chunk")
    found = written(dealt.mapInArrow(lean(_found), "doc long, `from` long, `to` long, hi long, lo long"), "found")
    drop_written(spark, taken)
    del dealt
    release(spark)

    unsure = found.filter("hi is not null")
    first = unsure.groupBy("hi", "lo").agg(F.min(F.struct("doc", "from")).alias("first"))
    later = unsure.join(first, ["hi", "lo"]).filter(F.struct("doc", "from") > F.col("first"))
    return found.filter("hi is null").select("doc", "from", "to").union(later.select("doc", "from", "to"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (binary, what
    remains of the text in UTF-8), one row for each row of ``docs``.

    A null text is empty. Rows without an id come after all others, in order of a hash of the text. Rows with the
    same id are one document that is repeated: no copy comes before another; if their texts differ, one text
    has the id and the others count as texts without one. Ids are below 2**62. Other columns are not
    read, so their names may clash.
    """
    keyed = with_key(docs, id_col, text_col)
    marks = spans(keyed).groupBy("doc").agg(F.collect_list(F.struct("from", "to")).alias("_spans"))

    def run(batches):
        for batch in batches:
            sizes, removed, number, kept = [], [], [], []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                joined: list[list[int]] = []
                for a, b in sorted((m["from"], min(m["to"], len(data))) for m in marks or ()):
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], b)
                    elif a < b:
                        joined.append([a, b])
                edges = [0, *(e for span in joined for e in span), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                sizes.append(len(data))
                removed.append(len(data) - len(kept[-1]))
                number.append(len(joined))
            counts = [pa.array(c, pa.int64()) for c in (sizes, removed, number)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return keyed.join(marks, "doc", "left").select(id_col, "text", "_spans").mapInArrow(
        lean(run), f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def digests(cleaned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result columns of the query."""
    return cleaned.select(F.col(id_col), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
