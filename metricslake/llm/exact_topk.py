"""Exact top-k search by tiled matrix products (operator 5).

Components become integers, so scores are exact: a tile of queries times a block of rows is
one matrix product, each row of the product keeps its k best by partial selection, and the
top lists are merged per task and then per query (:mod:`metricslake.llm.tiles`).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricslake.llm import tiles

#: Components are counted in units of 1 / SCALE.
SCALE = 1024


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of floored components; in doubles where these are exact, else in
    whole numbers of any size, held to the range of a long."""
    a, b = np.floor(q * SCALE), np.floor(x * SCALE)
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object)
    info = np.iinfo(np.int64)
    return np.clip(whole(a) @ whole(b).T, info.min, info.max).astype(np.int64)


def top_k(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each query the k rows with the highest
    integer inner product, ties to the smaller id, the query's own id left out (all, if fewer).

    Rows without an id, and vectors that are null, empty or hold a null or non-finite
    component take no part. Only vectors of the same dimension are compared. Rows with equal
    id and vector count once; of different vectors under one id the best counts. Other
    columns are not read, so their names may clash.
    """
    rows = tiles.usable(table, id_col, vec_col)
    queries = tiles.usable(table.filter(is_query), id_col, vec_col)

    def per_pair(q_ids, q, ids, x):
        scores = products(q, x)
        out = []
        for i, own in enumerate(q_ids):
            others = np.flatnonzero(ids != own)
            best = others[tiles.first_k(scores[i, others], ids[others], k, True)]
            out.append((np.full(len(best), own), ids[best], scores[i, best]))
        return tuple(map(np.concatenate, zip(*out)))

    return tiles.search(queries, rows, per_pair, "long", k, largest=True)


def query_rows(id_col: str = "vec_id", every: int = 100) -> Column:
    """The stated query set: ids divisible by ``every``."""
    return F.col(id_col) % every == 0


def oracle(k: int = 10, every: int = 100) -> str:
    """The query's rows in DuckDB SQL, all pairs of a query and a row."""
    return f"""
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as e
  from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pair as (
  select q.vec_id as query_id, c.vec_id as vec_id, max(list_inner_product(q.e::double[], c.e::double[]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % {every} = 0 group by all),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from pair)
select query_id, rank, vec_id, score from ranked where rank <= {k}
"""
