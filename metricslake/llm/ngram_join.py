"""N-gram Jaccard join with count-vector R-trees (operator 1).

A document's set holds its distinct word shingles as 64-bit hashes. Documents with equal
sets become one node. Candidates meet under shared rare shingles: in an order of all
shingles that puts rare ones first, two sets whose Jaccard similarity reaches the threshold
share a shingle among the first n - ceil(threshold * n) + 1 of each. (The order comes from a
table of counts of fixed size over all documents; any order gives right results.)

Under a shingle the nodes are points: the numbers of their shingles in each of GROUPS hash
groups. An R-tree over the points prunes: the overlap of two sets is at most the sum of the
smaller counts, and that of a set with anything in a box of the tree at most the sum of the
smaller of its counts and the box's upper corner. The pairs that survive are verified on
the sets themselves.

To keep groups of near copies from being written out as all their pairs, a first round
verifies for each point only its best neighbours. A second round verifies every remaining
pair between different components that the bound lets pass, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricslake.llm.common import drop_written, lean, release, written
from metricslake.llm.components import components

#: Coordinates of a point, and the bits of a shingle's hash that choose one.
GROUPS, GROUP_BITS = 64, 6
#: Counters of the frequency table (4 bytes each), sent to every task; a fixed size.
COUNTERS, COUNTER_CHUNKS = 1 << 20, 64
#: Points under one shingle are dealt into chunks of about so many; a task holds one pair of chunks.
CHUNK_ROWS = 512
#: Points in a leaf of the R-tree, and boxes in a box of a higher level.
LEAF_ROWS = FANOUT = 16
#: Of a node's common shingles so many, the smallest, go with its points.
SKETCH = 16
#: Pairs whose sketches are compared at once.
SKETCH_PAIRS = 4096
#: Neighbours of a point that the first round verifies under one shingle.
BEST = 2
WORD_CACHE = 300_000
#: Fills a sketch of fewer shingles.
NO_KEY = np.iinfo(np.int64).max


class Threshold(NamedTuple):
    """Jaccard similarity of at least ``part / whole``."""

    part: int
    whole: int

    def prefix(self, n: int) -> int:
        """How many of n shingles, rare ones first, hold one in common with any similar set."""
        return n + self.part * n // -self.whole + 1

    def reached(self, overlap, sizes):
        """Whether an overlap suffices for sets with this sum of sizes."""
        return (self.part + self.whole) * overlap >= self.part * sizes


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of a document's shingles of ``size`` words."""

    def __init__(self, size: int):
        self.size = size
        self.known: dict[bytes, int] = {}

    def word(self, word: bytes) -> int:
        code = self.known.get(word)
        if code is None:
            code = xxhash.xxh64_intdigest(word)
            if len(self.known) < WORD_CACHE:
                self.known[word] = code
        return code

    def of(self, text: str | None) -> np.ndarray:
        """Sorted hashes of the distinct shingles; fewer words than a shingle has are one."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and spaces
        if not words:
            return np.zeros(0, np.uint64)
        codes = np.fromiter(map(self.word, words), np.uint64, len(words))
        size = min(self.size, len(codes))
        out = np.full(len(codes) - size + 1, size, np.uint64)
        for k in range(size):
            out = mixed(out + codes[k : len(codes) - size + 1 + k])
        return np.unique(out)


def counters(docs: DataFrame, size: int, text_col: str = "text") -> np.ndarray:
    """How often the shingles of each hash class occur in all documents (COUNTERS numbers)."""
    width = COUNTERS // COUNTER_CHUNKS

    def count(batches):
        own, total = Shingler(size), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            sets = [own.of(t) for t in batch.column(0).to_pylist()]
            if sets:
                total += np.bincount((np.concatenate(sets) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        parts = np.minimum(total, 2**31 - 1).astype("<i4").reshape(COUNTER_CHUNKS, width)
        keep = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(keep, pa.int32()), "counts": [parts[k].tobytes() for k in keep]}, pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, "<i4").astype(np.int64)
        told = {"chunk": pa.array(list(sums), pa.int32()), "counts": [np.minimum(s, 2**31 - 1).astype("<i4").tobytes() for s in sums.values()]}
        yield pa.RecordBatch.from_pydict(told, pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]))

    form = "chunk int, counts binary"
    parts = docs.select(text_col).mapInArrow(lean(count), form).repartition(COUNTER_CHUNKS, "chunk").mapInArrow(lean(add), form)
    out = np.zeros((COUNTER_CHUNKS, width), "<i4")
    for row in parts.collect():  # COUNTER_CHUNKS rows
        out[row["chunk"]] = np.frombuffer(row["counts"], "<i4")
    return out.reshape(-1)


def points(docs: DataFrame, size: int, threshold: Threshold, counts: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row ``doc_id``, ``n``, ``hi`` and ``lo`` (hash of the set), ``keys`` (its rare
    shingles) and ``vec`` (GROUPS counts of one byte, or of four); the last four are null for an empty set."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        own = Shingler(size)
        for batch in batches:
            n, hi, lo, keys, vec = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                shingles = own.of(text)
                n.append(len(shingles))
                if not len(shingles):
                    for column in (hi, lo, keys, vec):
                        column.append(None)
                    continue
                code = xxhash.xxh128_intdigest(shingles.tobytes())
                hi.append((code >> 64) - (1 << 63))
                lo.append((code & (1 << 64) - 1) - (1 << 63))
                order = np.lexsort((shingles, sent.value[(shingles % np.uint64(COUNTERS)).astype(np.int64)]))
                keys.append(shingles[order[: threshold.prefix(len(shingles))]].view(np.int64))
                counted = np.bincount((shingles >> np.uint64(64 - GROUP_BITS)).astype(np.int64), minlength=GROUPS)
                vec.append(counted.astype("u1" if counted.max() < 256 else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(vec, pa.binary())],
                names=["doc_id", "n", "hi", "lo", "keys", "vec"],
            )

    form = "doc_id long, n long, hi long, lo long, keys array<long>, vec binary"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(lean(run), form)


class Tree:
    """An R-tree over points, packed by size and the coordinates of greatest spread.

    Level 0 has the leaves, each higher level the boxes of FANOUT boxes below; a box is told
    by its upper corner and its smallest set.
    """

    def __init__(self, n: np.ndarray, vec: np.ndarray):
        spread = np.argsort(-vec.var(0, dtype=np.float64), kind="stable")[:2]
        self.order = np.lexsort((vec[:, spread[1]], vec[:, spread[0]], n))
        self.n, self.vec = n[self.order], vec[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        upper, least, width = self.vec, self.n, LEAF_ROWS
        while True:
            begins = np.arange(0, len(least), width)
            upper, least, width = np.maximum.reduceat(upper, begins, axis=0), np.minimum.reduceat(least, begins), FANOUT
            self.levels.append((upper, least))
            if len(least) == 1:
                break

    def near(self, n: np.ndarray, vec: np.ndarray, threshold: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Queries, points and bound of the pairs that pass, leaf by leaf. Each box is met by the
        queries that may reach something in it; one that none may reach is dropped whole."""
        waiting = [(len(self.levels) - 1, 0, np.arange(len(n)))]
        while waiting:
            level, box, queries = waiting.pop()
            upper, least = self.levels[level][0][box], self.levels[level][1][box]
            bound = np.minimum(vec[queries], upper).sum(1, dtype=np.int64)
            queries = queries[threshold.reached(bound, n[queries] + least)]
            if not len(queries):
                continue
            if level:
                below = range(box * FANOUT, min((box + 1) * FANOUT, len(self.levels[level - 1][1])))
                waiting += [(level - 1, child, queries) for child in below]
                continue
            leaf = slice(box * LEAF_ROWS, (box + 1) * LEAF_ROWS)
            overlap = np.minimum(vec[queries, None, :], self.vec[None, leaf]).sum(2, dtype=np.int64)
            q, p = np.nonzero(threshold.reached(overlap, n[queries, None] + self.n[None, leaf]))
            yield queries[q], self.order[leaf.start + p], overlap[q, p]


class Group(NamedTuple):
    """Points that meet under shingles, sorted by group (a shingle and a pair of chunks)."""

    group: np.ndarray  # number of the group of each point
    key: np.ndarray
    node: np.ndarray
    n: np.ndarray
    vec: np.ndarray
    part: np.ndarray | None  # component
    side: np.ndarray | None  # of two chunks the first
    sketch: np.ndarray | None  # the node's SKETCH smallest common shingles, under a common one

    def near(self, threshold: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of a group that the bound lets pass: places of the smaller and the larger node, and
        the bound. Groups that fit one leaf of a tree are compared all at once, by distance
        in the sorted order; each larger one has its own tree and comes by itself."""
        sizes = np.bincount(self.group)
        leaf = (sizes <= LEAF_ROWS)[self.group]
        for step in range(1, LEAF_ROWS):
            i = np.flatnonzero((self.group[step:] == self.group[:-step]) & leaf[step:])
            if not len(i):
                break
            overlap = np.minimum(self.vec[i], self.vec[i + step]).sum(1, dtype=np.int64)
            total = self.n[i] + self.n[i + step]
            keep = threshold.reached(overlap, total) & (self.node[i] != self.node[i + step])
            i, j, bound = i[keep], i[keep] + step, overlap[keep] / total[keep]
            swap = self.node[i] > self.node[j]
            yield np.where(swap, j, i), np.where(swap, i, j), bound
        ends = np.cumsum(sizes)
        for k in np.flatnonzero(sizes > LEAF_ROWS):
            begin = ends[k] - sizes[k]
            own = slice(begin, ends[k])
            found = []
            for q, p, overlap in Tree(self.n[own], self.vec[own]).near(self.n[own], self.vec[own], threshold):
                i, j = begin + p, begin + q
                keep = self.node[i] < self.node[j]
                i, j = i[keep], j[keep]
                found.append((i, j, overlap[keep] / (self.n[i] + self.n[j])))
            yield tuple(map(np.concatenate, zip(*found)))

    def first_met(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether no smaller shingle stands in both sketches of a pair. The pair meets under such a
        shingle too, and is looked at there; that of its smallest shared one always passes, so a
        pair that shares many common shingles comes under few of them and under one at least."""
        out = np.ones(len(i), bool)
        if self.sketch is None:
            return out
        for begin in range(0, len(i), SKETCH_PAIRS):
            part = slice(begin, begin + SKETCH_PAIRS)
            one, two = self.sketch[i[part]], self.sketch[j[part]]
            shared = (one[:, :, None] == two[:, None, :]).any(2)
            least = np.where(shared, one, NO_KEY).min(1)
            out[part] = least >= self.key[i[part]]
        return out


def best_pairs(points: Group, threshold: Threshold) -> np.ndarray:
    """Of each point the pairs with its BEST neighbours by bound among those of smaller id.

    Every point that has any neighbour also comes paired with itself.
    """
    out = [np.zeros((0, 2), np.int64)]
    small = []
    for i, j, bound in points.near(threshold):
        if len(j) and np.bincount(points.group)[points.group[j[0]]] <= LEAF_ROWS:
            small.append((i, j, bound))  # a small group comes in several steps
        elif len(j):
            out.append(_best(points, i, j, bound))
    if small:
        out.append(_best(points, *map(np.concatenate, zip(*small))))
    return np.concatenate(out)


def _best(points: Group, i: np.ndarray, j: np.ndarray, bound: np.ndarray) -> np.ndarray:
    some = np.unique(np.concatenate([points.node[i], points.node[j]]))
    order = np.lexsort((points.node[i], -bound, j))
    i, j = i[order], j[order]
    keep = np.arange(len(j)) - np.searchsorted(j, j) < BEST
    return np.concatenate([np.stack([points.node[i[keep]], points.node[j[keep]]], 1), np.stack([some, some], 1)])


def all_pairs(points: Group, threshold: Threshold) -> np.ndarray:
    """The pairs that pass between different components; where two chunks meet only those across."""
    firsts, sizes = np.bincount(points.group, points.side), np.bincount(points.group)
    two = (firsts > 0) & (firsts < sizes)
    out = [np.zeros((0, 2), np.int64)]
    for i, j, _ in points.near(threshold):
        keep = (points.part[i] != points.part[j]) & (~two[points.group[i]] | (points.side[i] != points.side[j]))
        i, j = i[keep], j[keep]
        keep = points.first_met(i, j)
        out.append(np.stack([points.node[i[keep]], points.node[j[keep]]], 1))
    return np.concatenate(out)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[Group]:
    """Whole groups of rows with equal key, ci and cj, from rows sorted by them."""

    def groups(table: pa.Table) -> Group:
        packed = table.column("vec").to_pylist()
        if all(len(v) == GROUPS for v in packed):
            vec = np.frombuffer(b"".join(packed), "u1").reshape(-1, GROUPS)
        else:
            vec = np.stack([np.frombuffer(v, "u1" if len(v) == GROUPS else "<u4") for v in packed]).astype(np.int64)
        column = lambda name: table.column(name).to_numpy() if name in table.column_names else None
        sketch = None
        if "sketch" in table.column_names:
            told = table.column("sketch").combine_chunks()
            sizes = np.diff(told.offsets.to_numpy()) if len(told) else np.zeros(0, np.int64)
            sketch = np.full((len(told), SKETCH), NO_KEY)
            sketch[np.arange(SKETCH) < sizes[:, None]] = told.flatten().to_numpy()
        number = np.cumsum(changes(table)) - 1
        return Group(number, column("key"), column("node"), column("n"), vec, column("part"), column("side"), sketch)

    def changes(table: pa.Table) -> np.ndarray:
        keys = [table.column(k).to_numpy() for k in ("key", "ci", "cj")]
        return np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])

    waiting, rows = [], 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= 8 * CHUNK_ROWS:
            table = pa.Table.from_batches(waiting)
            last = int(np.flatnonzero(changes(table))[-1])  # the last group may go on
            if last:
                yield groups(table.slice(0, last))
            waiting, rows = table.slice(last).to_batches(), table.num_rows - last
    if rows:
        yield groups(pa.Table.from_batches(waiting))


def _pairs(rows: DataFrame, find, threshold: Threshold) -> DataFrame:
    """Distinct pairs ``a`` < ``b`` that ``find`` returns for the groups of (key, ci, cj)."""

    def run(batches):
        for group in _grouped(batches):
            found = np.unique(find(group, threshold), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0], pa.int64()), pa.array(found[:, 1], pa.int64())], names=["a", "b"])

    dealt = rows.repartition("key", "ci", "cj").sortWithinPartitions("key", "ci", "cj")
    return dealt.mapInArrow(lean(run), "a long, b long").distinct()


def _sets(size: int):
    def run(batches):
        own = Shingler(size)
        for batch in batches:
            found = [own.of(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    """The pairs whose sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("two"))
    overlap = F.size(F.array_intersect("one", "two")).cast("long")
    sizes = F.size("one").cast("long") + F.size("two")
    return pairs.join(left, "a").join(right, "b").filter(threshold.reached(overlap, sizes)).select("a", "b").distinct()


def _crossed(placed: DataFrame) -> DataFrame:
    """Deals points (``key``, ``node``, ``part``, with the ``main`` component under the key and the
    numbers ``mine`` and ``others`` of points in it and not) to cells (``key``, ``ci``, ``cj``) so that
    every two points of different components meet in one.

    Points of the main component meet only the others, so a large group of near copies that is one
    component by now goes out once for each chunk of the others, not for each chunk of its own.
    """

    def chunks(rows: str):
        return F.expr(f"cast(({rows} + {CHUNK_ROWS - 1}) div {CHUNK_ROWS} as int)")

    def own(rows: str):
        return F.pmod(F.xxhash64("node"), chunks(rows)).cast("int")

    def each(rows: str):
        return F.explode(F.sequence(F.lit(0), chunks(rows) - 1))

    def cells(rows: DataFrame, ci, cj, side) -> DataFrame:
        return rows.select("key", ci.cast("int").alias("ci"), cj.cast("int").alias("cj"), "node", "part", side.cast("int").alias("side"))

    inside, outside = placed.filter("part = main"), placed.filter("part <> main")
    mine, other = F.col("own"), F.col("other")
    across = cells(inside.select("*", own("mine").alias("own"), each("others").alias("other")), -1 - mine, other, F.lit(1))
    across = across.union(cells(outside.select("*", own("others").alias("own"), each("mine").alias("other")), -1 - other, mine, F.lit(0)))
    among = outside.select("*", own("others").alias("own"), each("others").alias("other"))
    return across.union(cells(among, F.least(mine, other), F.greatest(mine, other), mine <= other))


def join(docs: DataFrame, size: int, threshold: Threshold, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id``, one row for each row of ``docs``.

    ``component_id`` is the smallest id reachable by links between sets whose Jaccard similarity reaches the
    threshold, its own included. A null, empty or blank text has an empty set, linked with
    nothing. Rows with the same id are one document, linked by any of its texts; rows without
    an id are linked with nothing and have no component. Other columns are not read, so their
    names may clash.
    """
    spark = docs.sparkSession
    known = written(points(docs, size, threshold, counters(docs, size, text_col), id_col, text_col), "points")
    own = written(known.select("doc_id", "n", "hi", "lo"), "own")
    filled = known.filter("n > 0 and doc_id is not null")
    node_of = written(filled.groupBy("hi", "lo").agg(F.min("doc_id").alias("node")), "nodes")
    chosen = filled.join(node_of.withColumnRenamed("node", "doc_id"), ["hi", "lo", "doc_id"]).distinct()
    nodes = written(chosen.withColumnRenamed("doc_id", "node"), "points")
    drop_written(spark, known)
    release(spark)

    postings = nodes.select("node", F.explode("keys").alias("key"))
    shared = postings.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count("*").alias("rows")).filter("x < y")
    met = written(postings.join(shared.select("key", "rows"), "key"), "postings")
    flat = nodes.select("node", "n", "vec")
    release(spark)

    chunks = F.expr(f"cast((rows + {CHUNK_ROWS - 1}) div {CHUNK_ROWS} as int)")
    chunk = F.pmod(F.xxhash64("node"), chunks).cast("int")
    dealt = met.select("key", chunk.alias("ci"), F.lit(0).alias("cj"), "node").join(flat, "node").select("key", "ci", "cj", "node", "n", "vec")
    near = written(_pairs(dealt, best_pairs, threshold), "pairs")
    release(spark)

    # whatever the second round may verify is here or under a shingle of several chunks
    paired = near.select(F.explode(F.array("a", "b")).alias("node")).union(met.filter(chunks > 1).select("node")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    form = "node long, shingles array<long>"
    found = texts.join(paired, "node", "left_semi").mapInArrow(lean(_sets(size)), form).filter(F.size("shingles") > 0)
    sets = written(found, "sets")
    release(spark)

    tried = near.filter("a < b")
    links = written(_verified(tried, sets, threshold), "links")
    part = components(links)

    # the smallest of a node's shingles (part of its prefix) that many nodes share
    many = F.col("rows") > LEAF_ROWS
    sketches = met.filter(many).groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, SKETCH).alias("sketch"))
    placed = met.join(part, "node", "left").select("key", "node", "rows", F.coalesce("component", "node").alias("part"))
    parts = placed.groupBy("key", "part").agg(F.count("*").alias("rows"))
    main = parts.groupBy("key").agg(F.max_by("part", F.struct("rows", "part")).alias("main"), F.sum("rows").alias("rows"), F.max("rows").alias("mine"))
    apart = main.filter("mine < rows").select("key", "main", "mine", (F.col("rows") - F.col("mine")).alias("others"))
    crossed = _crossed(placed.drop("rows").join(apart, "key"))
    crossed = crossed.join(flat.join(sketches, "node", "left"), "node").select(
        "key", "ci", "cj", "node", "n", "part", "side", "vec", F.coalesce("sketch", F.array().cast("array<long>")).alias("sketch")
    )
    rest = written(_pairs(crossed, all_pairs, threshold).join(tried, ["a", "b"], "left_anti"), "pairs")
    drop_written(spark, met, nodes, near)
    del crossed, placed, parts, main, apart, sketches, met, nodes, near, tried
    release(spark)
    more = _verified(rest, sets, threshold)
    linked = components(more.union(part.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    drop_written(spark, rest, sets, links)
    del rest, sets, links, more
    release(spark)

    reached = own.join(node_of, ["hi", "lo"], "left").join(linked, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    out = reached.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    out = written(out, "joined")
    drop_written(spark, own, node_of)
    return out
