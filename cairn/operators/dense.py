"""Exact nearest neighbours by cosine: blocks of queries meet blocks of vectors.

Both sides are dealt into blocks of bounded bytes by a hash of their ids, and each pair of
blocks is a group of its own, so neither side ever stands in the driver or in every task.
A group multiplies its blocks, keeps what can still be among the k best of a query within
the rounding of that product, and scores it anew component after component: equal vectors
have equal scores wherever they stand. It passes on its k best of each query only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
LEAST_BLOCKS = 8
MOST_PAIRS = 1 << 21
"""Pairs of a query and a vector whose product a task holds at once."""


def _usable(vector: Column) -> Column:
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)), F.lit(False))


def _stack(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.float64).reshape(-1, width)


def _sum_in_order(x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape[:-1])
    for d in range(x.shape[-1]):
        out = out + x[..., d]
    return out


def _best(q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, unit: bool):
    """Places of the query, ids and scores of each query's k best; the product of some queries at a time."""
    length = lambda x: np.sqrt(_sum_in_order(x * x)) if unit else np.ones(len(x))
    q_long, v_long = (np.where(n > 0, n, 1.0) for n in (length(q), length(v)))
    unit_v = (v / v_long[:, None]).T
    slack = 1e-14 * (q.shape[1] + 16) * (1.0 if unit else max(1.0, np.abs(q).max(initial=0) * np.abs(v).max(initial=0)))
    kk = min(k, len(ids))
    step = max(1, MOST_PAIRS // len(ids))
    for begin in range(0, len(q), step):
        near = (q[begin : begin + step] / q_long[begin : begin + step, None]) @ unit_v
        floor = np.partition(near, len(ids) - kk, axis=1)[:, len(ids) - kk] - slack
        for at, row in enumerate(near, begin):
            may = np.flatnonzero(row >= floor[at - begin])
            score = _sum_in_order(q[at] * v[may]) / (q_long[at] * v_long[may])
            best = np.lexsort((ids[may], -score))[:k]
            yield np.full(len(best), at), ids[may[best]], score[best]


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", unit: bool = True) -> DataFrame:
    """qid, key, score, rank of the k nearest of each query (qid, v); vectors of another width than the queries take no part."""
    asked = queries.select(F.col("qid").cast("long").alias("qid"), "v").filter(_usable(F.col("v")))
    n_queries, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    width = width or 1
    good = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter(_usable(F.col("v")) & (F.size("v") == width))
    rows = max(64, BLOCK_BYTES // (8 * width))
    q_blocks = max(1, -(-n_queries // rows))
    v_blocks = max(LEAST_BLOCKS, -(-good.count() // rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.filter(F.size("v") == width).select("qid", "v", deal("qid", q_blocks).alias("qb"), every(v_blocks).alias("vb"))
    # by the vector too: rows that share an id need not share a block
    right = good.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(v_blocks)).cast("int").alias("vb"), every(q_blocks).alias("qb"))

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if q.num_rows and v.num_rows:
            found += _best(_stack(q["v"], width), np.asarray(v["id"]), _stack(v["v"], width), k, unit)
        at, ids, scores = (np.concatenate(x) for x in zip(*found))
        qids = q["qid"].combine_chunks().take(pa.array(at)) if q.num_rows else pa.array([], pa.int64())
        return pa.Table.from_arrays([qids, pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["qid", "id", "score"])

    found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(run, "qid long, id long, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    out = found.withColumn("rank", F.row_number().over(best).cast("long"))
    return out.filter(F.col("rank") <= k).select("qid", F.col("id").alias(key), "score", "rank")
