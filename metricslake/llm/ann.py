"""Approximate nearest neighbours by multi-index hashing (operator 2).

A model learned on a bounded sample turns a vector into a binary code: projection on the
principal directions, a rotation that brings the projections close to the corners of a cube
(iterative quantization), and signs. Codes are split into substrings and each substring is
indexed. By the pigeonhole principle two codes within Hamming radius r = m * s + a (m
substrings) agree within radius s in one of the first a + 1 substrings, or within s - 1 in
one of the others; probing those buckets retrieves every code within r. The retrieved rows
are compared with the query by exact distance.

The radius is learned on the sample too. In a block with fewer than k codes within it the
radius grows until there are k or the block is exhausted, so every query gets k rows if the
table has them. Each block of :mod:`metricslake.llm.tiles` is indexed once, and its index stored
with it, whatever number of tiles of queries it meets; every row is indexed.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricslake.llm import tiles
from metricslake.llm.common import thinned

#: Rows of the sample that the codes and the radius are learned from (a bound).
SAMPLE_ROWS = 6000
SAMPLE_QUERIES = 200
#: Share of the sample's true neighbours that lie within the learned radius.
RADIUS_RECALL = 0.94
BITS, SUBSTRING_BITS = 64, 8
ROUNDS, SEED = 30, 11


class Codes(NamedTuple):
    """Projection to signs, and the radius of the search."""

    mean: np.ndarray
    projection: np.ndarray
    radius: int

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of bytes, one substring each."""
        return np.packbits((x - self.mean) @ self.projection > 0, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


def learn(x: np.ndarray, k: int) -> Codes:
    """Codes of at most BITS bits from a sample, and the radius that holds its neighbours."""
    rng = np.random.default_rng(SEED)
    mean = x.mean(0)
    centred = x - mean
    bits = min(BITS, x.shape[1])
    _, directions = np.linalg.eigh(centred.T @ centred)
    principal = directions[:, ::-1][:, :bits]
    z = centred @ principal
    rotation = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(ROUNDS):
        u, _, v = np.linalg.svd(z.T @ np.where(z @ rotation > 0, 1.0, -1.0))
        rotation = u @ v
    codes = Codes(mean, principal @ rotation, bits)
    own, radii = codes.of(x), []
    for i in range(min(SAMPLE_QUERIES, len(x))):
        distance = ((x - x[i]) ** 2).sum(1)
        distance[i] = np.inf
        near = np.argsort(distance, kind="stable")[: min(k, len(x) - 1)]
        radii.append(hamming(own[near], own[i]))
    radii = np.concatenate(radii) if radii else np.zeros(0)
    return codes._replace(radius=int(np.quantile(radii, RADIUS_RECALL, method="higher"))) if len(radii) else codes


@lru_cache(maxsize=1)
def ball_order() -> tuple[np.ndarray, np.ndarray]:
    """All masks of a substring by their number of ones, and where each number begins."""
    masks = np.arange(1 << SUBSTRING_BITS, dtype=np.uint8)
    ones = np.bitwise_count(masks)
    order = np.argsort(ones, kind="stable")
    return masks[order], np.searchsorted(ones[order], np.arange(SUBSTRING_BITS + 2))


class MultiIndex(NamedTuple):
    """For each substring the rows of a block by its value, and where the rows of each value begin."""

    codes: np.ndarray
    rows: np.ndarray
    begin: np.ndarray

    @classmethod
    def build(cls, codes: np.ndarray) -> MultiIndex:
        rows = np.argsort(codes.T, axis=1, kind="stable").astype("<u4")
        values = np.arange((1 << SUBSTRING_BITS) + 1)
        begin = [np.searchsorted(part[order], values) for part, order in zip(codes.T, rows)]
        return cls(codes, rows, np.array(begin, "<u4"))

    def stored(self) -> bytes:
        return b"".join(np.ascontiguousarray(part).tobytes() for part in self)

    @classmethod
    def read(cls, data: bytes, size: int) -> MultiIndex:
        """The index of ``size`` rows from what :meth:`stored` gave."""
        buckets = (1 << SUBSTRING_BITS) + 1
        parts = len(data) // (5 * size + 4 * buckets)
        codes = np.frombuffer(data, np.uint8, parts * size).reshape(size, parts)
        rows = np.frombuffer(data, "<u4", parts * size, parts * size).reshape(parts, size)
        begin = np.frombuffer(data, "<u4", offset=5 * parts * size).reshape(parts, buckets)
        return cls(codes, rows.astype(np.intp), begin.astype(np.intp))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code lies within the radius: pigeonhole probes, then whole codes."""
        masks, begins = ball_order()
        whole, rest = divmod(radius, len(self.rows))
        hit = np.zeros(len(self.codes), bool)
        for part, (rows, begin) in enumerate(zip(self.rows, self.begin)):
            reach = min(whole if part <= rest else whole - 1, SUBSTRING_BITS)
            if reach >= 0:
                values = (masks[: begins[reach + 1]] ^ code[part]).astype(np.intp)
                first, size = begin[values], begin[values + 1] - begin[values]
                # the buckets' places in ``rows``, one bucket after the other
                places = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                hit[rows[places]] = True
        found = np.flatnonzero(hit)
        return found[hamming(self.codes[found], code) <= radius]


def fit(table: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> dict[int, Codes]:
    """Codes for each dimension from at most SAMPLE_ROWS of its rows, drawn by a hash of id and vector."""
    rows = usable(table, id_col, vec_col).select("vec", F.size("vec").alias("dim"), F.xxhash64("id", "vec").alias("pick"))
    near = thinned(rows, "dim", "pick", SAMPLE_ROWS).dropDuplicates(["pick"])
    by = Window.partitionBy("dim").orderBy("pick")
    near = near.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= SAMPLE_ROWS)
    sample: dict[int, list] = {}
    for r in near.select("dim", "vec").orderBy("dim", "pick").collect():
        sample.setdefault(r["dim"], []).append(r["vec"])
    return {dim: learn(np.array(x), k) for dim, x in sample.items()}


def usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    rows = tiles.usable(table, id_col, vec_col)
    return rows.filter(F.exists("vec", lambda x: x != 0))


def nearest(
    table: DataFrame, is_query: Column, codes: dict[int, Codes], k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each query the k nearest rows found,
    by Euclidean distance in doubles, ties to the smaller id, the query's own id left out.

    Rows without an id, and vectors that are null, empty, zero or hold a null or non-finite
    component take no part. Only vectors of the same dimension are compared. Rows with equal
    id and vector count once; of different vectors under one id the nearest counts. Other
    columns are not read, so their names may clash.
    """
    rows = usable(table, id_col, vec_col)
    queries = usable(table.filter(is_query), id_col, vec_col)
    sent = table.sparkSession.sparkContext.broadcast(codes)

    def index_of(x):
        return MultiIndex.build(sent.value[x.shape[1]].of(x)).stored()

    def per_pair(q_ids, q, ids, x, stored):
        model = sent.value[x.shape[1]]
        index, q_codes = MultiIndex.read(stored, len(ids)), model.of(q)
        bits = 8 * q_codes.shape[1]
        out = []
        for own, vector, code in zip(q_ids, q, q_codes):
            radius = model.radius
            while True:
                found = index.within(code, radius)
                found = found[ids[found] != own]
                if len(found) >= k or radius >= bits:
                    break
                radius += max(1, bits // 16)
            distance = np.sqrt(((x[found] - vector) ** 2).sum(1))
            best = tiles.first_k(distance, ids[found], k, False)
            out.append((np.full(len(best), own), ids[found[best]], distance[best]))
        return tuple(map(np.concatenate, zip(*out)))

    return tiles.search(queries, rows, per_pair, "double", k, largest=False, index_of=index_of)
