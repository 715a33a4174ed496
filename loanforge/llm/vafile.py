"""Exact top-k inner-product search with vector-approximation files.

Vectors and queries are dealt by hash into blocks of bounded size, and every pair of a
query block and a vector block is one task-sized cell. In a cell each vector is held as
quantised components, a few bits per dimension. A scan of these gives an upper and a
lower bound of every score; vectors whose upper bound is below the k-th best lower bound
drop out, and the exact vectors of the rest are read in bound order until the k-th exact
score is above every bound to come. The best of all cells of a query are ranked at the end.

Results: vectors that are null, empty or hold null or non-finite components, and rows
without id, take no part. Components beyond 32 bits after quantising and scores beyond
64 bits saturate. Vectors are compared with queries of the same length only. A query
meets every row whose id differs from its own; repeated rows are candidates each, repeated
queries count once. Equal scores go to the smaller id. Fewer than k candidates give
fewer rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VECTORS_PER_BLOCK = 65_536
QUERIES_PER_BLOCK = 8_192
CELLS = 16
_AT_ONCE = 256
_STEP = 64


def quantised(vec: Column, scale: float = 64.0) -> Column:
    """``floor(scale * x)`` of every component; null when the vector takes no part."""
    fine = F.forall(vec, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(fine & (F.size(vec) > 0), F.transform(vec, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(2**31 - 1)), F.lit(-(2**31))).cast("int")))


def cell_bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower corner of each vector's cell and the cell width less one per dimension."""
    low = x.min(axis=0)
    width = np.maximum(-(-(x.max(axis=0) - low + 1) // CELLS), 1)
    cells = ((x - low) // width).astype(np.uint8)
    return low + cells * width, width - 1


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """``(query row, vector row, score)`` of the ``k`` best of one cell per query."""
    out: list[tuple[int, int, int]] = []
    if float(np.abs(q).max()) * float(np.abs(x).max()) * x.shape[1] >= 2**52:  # beyond exact floating point: plain whole numbers
        xs = x.astype(object)
        for r in range(len(q)):
            s = xs @ q[r].astype(object)
            best = sorted((-int(v), int(i), j) for j, (v, i) in enumerate(zip(s, ids)) if i != qids[r])[:k]
            out += [(r, j, max(min(-v, 2**63 - 1), -(2**63))) for v, _, j in best]
        return out
    corner, spread = cell_bounds(x)
    corner, exact = corner.astype(float), x.astype(float)
    for at in range(0, len(q), _AT_ONCE):
        part = q[at : at + _AT_ONCE].astype(float)
        upper = part @ corner.T
        lower = upper + (np.minimum(part, 0) @ spread)[:, None]
        upper += (np.maximum(part, 0) @ spread)[:, None]
        own = ids[None, :] == qids[at : at + _AT_ONCE, None]
        upper[own] = lower[own] = -np.inf
        some = min(k, upper.shape[1])
        limit = np.partition(lower, upper.shape[1] - some, axis=1)[:, upper.shape[1] - some]
        for r in range(len(part)):
            rows = np.flatnonzero((upper[r] >= limit[r]) & (upper[r] > -np.inf))
            rows = rows[np.lexsort((ids[rows], -upper[r, rows]))]
            got, score = rows[:0], np.zeros(0)
            for i in range(0, len(rows), _STEP):
                if len(got) == k and score[-1] > upper[r, rows[i]]:
                    break
                new = rows[i : i + _STEP]
                got, score = np.concatenate((got, new)), np.concatenate((score, exact[new] @ part[r]))
                order = np.lexsort((ids[got], -score))[:k]
                got, score = got[order], score[order]
            out += [(at + r, int(j), int(s)) for j, s in zip(got, score)]
    return out


def _matrix(c: pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in c.chunks]).astype(np.int64).reshape(rows, -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding", scale: float = 64.0, per_block: int = VECTORS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """``query``, ``rank``, ``vec_id``, ``score``: the ``k`` best rows of ``vectors`` for each row of ``queries``."""

    def ready(df: DataFrame, names: tuple[str, str]) -> DataFrame:
        return df.select(F.col(key).cast("bigint").alias(names[0]), quantised(F.col(vec), scale).alias(names[1])).where(F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull())

    x, q = ready(vectors, ("id", "v")), ready(queries, ("qid", "q")).distinct()
    n, nq = x.count(), q.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    x_blocks = max(-(-n // per_block), min(2 * cores, -(-n // 1024)), 1)
    q_blocks = max(-(-nq // queries_per_block), 1)

    def block(column: str, of: int, other: int, names: tuple[str, str]) -> list[Column]:
        own = F.pmod(F.xxhash64(column), F.lit(of)).cast("int").alias(names[0])
        return [own, F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(names[1])]

    xs = x.select("id", "v", F.size("v").alias("d"), *block("id", x_blocks, q_blocks, ("b", "c")))
    qs = q.select("qid", "q", F.size("q").alias("d"), *block("qid", q_blocks, x_blocks, ("c", "b")))

    def cell(q: pa.Table, x: pa.Table) -> pa.Table:
        names = ["query", "twin", "vec_id", "score"]
        if not q.num_rows or not x.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        ids, qids = x.column("id").to_numpy(), q.column("qid").to_numpy()
        mq = _matrix(q.column("q"), q.num_rows)
        found = search(_matrix(x.column("v"), x.num_rows), ids, mq, qids, k)
        r, j, s = (np.array(c, dtype=np.int64) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        twin = q.column("twin").to_numpy()
        return pa.table({"query": qids[r], "twin": twin[r], "vec_id": ids[j], "score": s})

    qs = qs.withColumn("twin", F.xxhash64("q"))  # tells queries of one id apart
    best = qs.groupBy("c", "b", "d").cogroup(xs.groupBy("c", "b", "d")).applyInArrow(cell, "query bigint, twin bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("query", "twin").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "vec_id", "score")
