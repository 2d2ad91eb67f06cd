"""Vectors in tiles: a stated set of queries against all rows, block by block.

Rows are packed where they lie into blocks of at most ``BLOCK_ROWS`` vectors, queries into
tiles of at most ``TILE_ROWS``. Every tile is copied to each of ``lanes`` lanes, a block
stays in one lane, and the two meet by an equality join on the lane, so each pair of a block
and a tile meets once and a task holds one such pair at a time. Per pair at most k rows a
query come out; their top lists are merged per task and then per query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricslake.llm.common import lean, written

BLOCK_ROWS = 4096
TILE_ROWS = 512


def usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id`` and ``vec`` (doubles) of rows with an id and a vector of finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    vec = F.col("vec")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.filter(F.col("id").isNotNull() & vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, finite))


def _packs(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        waiting: dict[int, dict[tuple[int, bytes], None]] = {}
        made = 0

        def packed(rows: dict) -> pa.RecordBatch:
            nonlocal made
            ids, vectors = zip(*rows)
            made += 1
            columns = [
                pa.array([len(vectors[0]) // 8], pa.int32()),
                pa.array([part + made], pa.int64()),
                pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                pa.array([b"".join(vectors)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["dim", "turn", "ids", "data"])

        for batch in batches:
            vec = batch.column(1)
            offsets = vec.offsets.to_numpy()
            values = vec.values.to_numpy(zero_copy_only=False).astype("<f8")
            for i, a, b in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:]):
                rows = waiting.setdefault(b - a, {})
                rows[i, values[a:b].tobytes()] = None  # a row that is repeated counts once
                if len(rows) == size:
                    yield packed(waiting.pop(b - a))
        for rows in waiting.values():
            yield packed(rows)

    return run


def packs(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows of equal dimension: ``dim``, ``turn``, ``ids``, ``data``."""
    return rows.mapInArrow(lean(_packs(size)), "dim int, turn long, ids binary, data binary")


def _with_index(index_of: Callable[[np.ndarray], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.slice(row, 1)
                vectors = np.frombuffer(block.column("data")[0].as_py(), "<f8").reshape(-1, block.column("dim")[0].as_py())
                yield block.append_column("index", pa.array([index_of(vectors)], pa.binary()))

    return run


Search = Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]


def first_k(scores: np.ndarray, ids: np.ndarray, k: int, largest: bool) -> np.ndarray:
    """Places of the k best scores, of equal ones those with the smaller id; partial selection first."""
    if largest:
        scores = ~scores if scores.dtype.kind == "i" else -scores  # -x - 1, which no long overflows
    if len(scores) > k:
        bound = np.partition(scores, k - 1)[k - 1]
        places = np.flatnonzero(scores <= bound)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], scores[places]))[:k]]


def search(
    queries: DataFrame,
    rows: DataFrame,
    per_pair: Search,
    score_type: str,
    k: int,
    largest: bool,
    index_of: Callable[[np.ndarray], bytes] | None = None,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k best rows of each query, ties by id.

    ``per_pair`` gets query ids and vectors of a tile, row ids and vectors of a block, and
    returns query ids, row ids and scores of at least the k best rows of each query in the
    block, without the query's own row. With ``index_of`` a block's index is made once from its vectors
    and stored with the block in the shared folder; ``per_pair`` gets it last.
    """
    spark = rows.sparkSession
    lanes = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    every_lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    tiles = packs(queries, TILE_ROWS).select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), every_lane)
    blocks, extra = packs(rows, BLOCK_ROWS), []
    if index_of is not None:
        blocks, extra = written(blocks.mapInArrow(lean(_with_index(index_of)), "dim int, turn long, ids binary, data binary, index binary"), "blocks"), ["index"]
    blocks = blocks.withColumn("lane", F.pmod(F.col("turn"), F.lit(lanes)).cast("int"))
    pairs = blocks.join(tiles, ["lane", "dim"]).select("dim", "q_ids", "q_data", "ids", "data", *extra)
    kind = {"double": pa.float64(), "long": pa.int64()}[score_type]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                dim, q_ids, q_data, ids, data, *index = (c[row].as_py() for c in batch.columns)
                vectors = lambda x: np.frombuffer(x, "<f8").reshape(-1, dim)  # noqa: B023, E731
                q, v, s = per_pair(np.frombuffer(q_ids, "<i8"), vectors(q_data), np.frombuffer(ids, "<i8"), vectors(data), *index)
                columns = [pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(lean(run), f"query_id long, vec_id long, score {score_type}")
    # a repeated row may come from two blocks
    once = found.groupBy("query_id", "vec_id").agg((F.max if largest else F.min)("score").alias("score"))
    order = F.col("score").desc() if largest else F.col("score")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
