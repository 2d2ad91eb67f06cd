"""Target-distribution importance resampling over hashed n-grams (operator 11).

Two sets of texts are described by how often each of BUCKETS hash buckets of n-grams occurs
in them. A bucket's gain is the smoothed log-ratio of its share in the target to its share
in the documents, a document's weight the mean gain of its n-grams, and its score the weight
plus a Gumbel variable seeded by its id: the highest scores are a draw without replacement
in proportion to the exponent of the weights.

Texts go through Arrow kernels: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and
``dictionary_encode``. Longer n-grams are pairs of the dictionary number of the n-gram before
and of the next word, read from the shifted numbers; each distinct pair is hashed once, by
going on with the CRC of the n-gram before. Gains are taken by bucket and summed by segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricslake.llm.common import lean, written

BUCKETS = 10_000
#: What stands between words: every ASCII character but digits and lower-case letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Gains and scores are whole numbers of this fraction of a nat.
SCALE = 1000
#: Texts that the kernels see at once, a bound on memory (one longer text comes by itself).
SLICE_BYTES = 8 << 20


class Grams(NamedTuple):
    """Hashed n-grams of some texts: a bucket for each, the place of each one's text, and words by text."""

    bucket: np.ndarray
    text: np.ndarray
    words: np.ndarray


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Parts of an array of about SLICE_BYTES."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield texts.slice(begin, end - begin)
        begin = end


def grams(texts: pa.Array, low: int, high: int, buckets: int = BUCKETS) -> Grams:
    """All runs of ``low`` to ``high`` consecutive words of each text."""
    lower = pc.ascii_lower(pc.fill_null(texts, ""))
    parts = pc.split_pattern_regex(lower, BREAK)
    text = pc.list_parent_indices(parts).to_numpy()
    flat = pc.list_flatten(parts)
    some = pc.not_equal(flat, "")
    text = text[some.to_numpy(zero_copy_only=False)]
    coded = pc.dictionary_encode(flat.filter(some))
    word = coded.indices.to_numpy().astype(np.int64)
    names = [w.encode("utf-8", "surrogatepass") for w in coded.dictionary.to_pylist()]
    code, crcs = word, np.fromiter(map(zlib.crc32, names), np.int64, len(names))
    found, owners = [], []
    for n in range(1, high + 1):
        if n > 1:
            same = text[: len(code) - 1] == text[n - 1 :] if len(code) else np.zeros(0, bool)
            pairs = code[:-1] * len(names) + word[n - 1 :]  # an n-gram that leaves its text is never used
            pairs = np.where(same, pairs, -1)
            known, code = np.unique(pairs, return_inverse=True)
            crcs = np.fromiter(
                (zlib.crc32(b" " + names[p % len(names)], int(crcs[p // len(names)])) if p >= 0 else 0 for p in known.tolist()),
                np.int64,
                len(known),
            )
            inside = same
        else:
            inside = np.ones(len(code), bool)
        if n >= low:
            found.append((crcs % buckets)[code[inside]])
            owners.append(text[: len(code)][inside])
    bucket = np.concatenate(found) if found else np.zeros(0, np.int64)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    if len(found) > 1:
        order = np.argsort(owner, kind="stable")
        bucket, owner = bucket[order], owner[order]
    return Grams(bucket, owner, np.bincount(text, minlength=len(texts)))


def bucket_counts(texts: DataFrame, text_col: str, low: int, high: int, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all texts fall in each bucket; ``buckets`` numbers reach the driver."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                total += np.bincount(grams(part, low, high, buckets).bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    told = texts.select(F.col(text_col).cast("string")).mapInArrow(lean(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in told.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Smoothed log-ratio of each bucket's share in the target to that in the documents, floored."""
    s, t = documents.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(SCALE * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, low: int, high: int, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, ``n_words``, ``n_features`` and ``weight`` of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            begin = 0
            for part in slices(batch.column(1)):
                found = grams(part, low, high, len(sent.value))
                n = np.bincount(found.text, minlength=len(part))
                ends = np.cumsum(n)
                running = np.concatenate([[0], np.cumsum(sent.value[found.bucket])])  # whole numbers
                total = running[ends] - running[ends - n]
                columns = [found.words, n, total // np.maximum(n, 1)]
                ids = batch.column(0).slice(begin, len(part))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns)], names=[id_col, "n_words", "n_features", "weight"])
                begin += len(part)

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(lean(run), f"`{id_col}` {kind}, n_words long, n_features long, weight long")


def gumbel(id_col: str, seed: int) -> Column:
    """A Gumbel variable seeded by the id, in whole numbers; rows without an id have an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-float(SCALE) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... in this order, by sorted ranges: nothing meets in one
    task, and only one count for each range is summed up."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(sorted_rows.withColumn("_place", F.monotonically_increasing_id()), name)
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + within + 1).drop("_part", "_place", "_start")


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: tuple[int, int],
    seed: int,
    low: int = 1,
    high: int = 1,
    least_words: int = 20,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """Draw ``share`` (a fraction) of the documents with at least ``least_words`` words, those
    whose words are likelier in ``target`` with a higher chance.

    Returns one row for each row of ``docs``: ``id_col``, ``n_words``, ``n_features``,
    ``weight``, ``score`` and ``rank`` (1 for the highest score, ties to the smaller id; null if
    not drawn). A null or empty text has no words and weight 0. Rows that repeat an id are
    drawn one by one, rows without an id come after the others of their score. An empty target
    or table gives gains from the smoothing alone. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col, low, high, buckets), bucket_counts(target, target_col, low, high, buckets))
    found = weights(docs, gain, low, high, id_col, text_col)
    scored = written(found.withColumn("score", F.col("weight") + gumbel(id_col, seed)), "scores")

    able = F.col("n_words") >= least_words
    # scores are whole numbers between fixed bounds (below 2 ** 18 of them), so is the table of their counts
    counts = scored.filter(able).groupBy("score").agg(F.count("*").alias("n"))
    above = counts.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("score"))))
    total = counts.agg(F.sum("n").alias("total"))
    part, whole = share
    wanted = above.crossJoin(F.broadcast(total)).withColumn("wanted", F.expr(f"{part} * total div {whole}"))  # one row
    last = wanted.filter("above >= wanted").agg(F.max("score").alias("last"), F.max("wanted").alias("wanted")).first()
    none = last["wanted"] is None or last["wanted"] == 0
    drawn = able & F.lit(not none) & (F.col("score") >= F.lit(0 if none else last["last"]))

    order = [F.desc("score"), F.asc_nulls_last(id_col)]
    top = ranked(scored.filter(drawn), order, "drawn")
    top = top.withColumn("rank", F.when(F.col("rank") <= F.lit(last["wanted"] or 0), F.col("rank")))
    rest = scored.filter(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return top.select(rest.columns).unionByName(rest)


def drawn_documents(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, whole, whose id was drawn in ``ranks``."""
    return docs.join(ranks.filter("rank is not null").select(id_col).distinct(), id_col, "left_semi").select(*docs.columns)


def oracle(share: tuple[int, int], seed: int, least_words: int = 20, buckets: int = BUCKETS) -> str:
    """The query's rows (single words) in DuckDB SQL; the CRC table follows from its rule."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    step = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    rule = f"list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: {step})"
    byte = "[('0x' || substr(hex(encode(word)), 2 * k + 1, 2))::bigint for k in range(octet_length(encode(word)))]"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, {byte}), lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295)"
    return rf"""
with crc as (select list({rule} order by i) as entries from range(256) as r(i)),
doc as (select doc_id, {words} as words, row_number() over () as row from documents),
used as (select row, unnest(words) as word from doc),
aim as (select unnest({words}) as word from benchmark),
bucket as (select word, ({crc} % {buckets})::bigint as bucket from (select word from used union select word from aim) cross join crc),
s as (select bucket, count(*) as s from used join bucket using (word) group by all),
t as (select bucket, count(*) as t from aim join bucket using (word) group by all),
totals as (select (select count(*) from used) as big_s, (select count(*) from aim) as big_t),
gain as (
  select b.bucket, floor({SCALE} * ln((coalesce(t, 0)::double + 1) * (big_s::double + {buckets}) / ((coalesce(s, 0)::double + 1) * (big_t::double + {buckets}))))::bigint as gain
  from (select distinct bucket from bucket) b left join s using (bucket) left join t using (bucket) cross join totals),
mean as (
  select row, count(*) as n, sum(gain)::bigint as total from used join bucket using (word) join gain using (bucket) group by row),
scored as (
  select doc_id, len(words) as n_features, coalesce(floor(total::double / n)::bigint, 0) as weight,
    floor(-{SCALE}.0::double * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint as chance
  from doc left join mean using (row)),
placed as (
  select *, weight + chance as score, n_features >= {least_words} as able,
    row_number() over (partition by n_features >= {least_words} order by weight + chance desc, doc_id) as place,
    count(*) filter (n_features >= {least_words}) over () as total
  from scored)
select doc_id, n_features::bigint as n_features, weight, score,
  case when able and place <= {share[0]} * total // {share[1]} then place end::bigint as rank
from placed
"""
