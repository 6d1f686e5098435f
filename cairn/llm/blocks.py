"""Queries against all rows in blocks: shared by the two vector searches.

Rows alike in id and vector are counted first, before a shuffle moves them, so that one
row stands for any number of copies. Queries and candidates are then dealt into blocks by
a hash of id and vector; each pair of a query block and a candidate block is one group
and gives its own best of each query; heaps merge these, a row at a time. A block has a
bounded number of bytes, whatever the data hold.

A query's own row takes part in the blocks and leaves the merged heap: that of all rows
the best k + 1, without one row of the query's id and the query's score with itself, are
the best k of the others.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, with_copies

BLOCK_BYTES = 4 << 20


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def stack(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows of doubles, filled up with zeros."""
    lists = column.combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = np.asarray(lists.flatten(), np.float64)
    return out


def fold(ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors with a row for each copy, of equal vectors the ``most`` smallest ids: ties leave no others among the best."""
    times = np.minimum(copies, most)
    ids, vectors = np.repeat(ids, times), np.repeat(vectors, times, axis=0)
    kinds = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel() if vectors.shape[1] else np.zeros(len(ids), "V1")
    _, kind = np.unique(kinds, return_inverse=True)
    order = np.lexsort((ids, kind))
    kind = kind[order]
    first = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    place = np.arange(len(kind)) - np.repeat(first, np.diff(np.r_[first, len(kind)]))
    keep = np.sort(order[place < most])
    return ids[keep], vectors[keep]


def best(score, ids: np.ndarray, k: int) -> list[int]:
    """Places of the k highest scores, ties to the smaller id."""
    if isinstance(score, np.ndarray) and score.dtype != object:
        return np.lexsort((ids, -score))[:k].tolist()
    return sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:k]


class Heap:
    """The k best (score, id) of a query, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.items = k, []

    def push(self, score, vec_id: int) -> None:
        if len(self.items) < self.k:
            heapq.heappush(self.items, (score, -vec_id))
        elif (score, -vec_id) > self.items[0]:
            heapq.heapreplace(self.items, (score, -vec_id))

    def least(self) -> float:
        """What a score must reach to come in."""
        return self.items[0][0] if len(self.items) == self.k else -np.inf

    def ranked(self) -> list[tuple]:
        return [(s, -i) for s, i in sorted(self.items, reverse=True)]


def _merge(k: int, score_type: pa.DataType):
    """Sorted rows of partial results to the k best of each query, without its own row."""
    names = ["query_id", "copies", "rank", "vec_id", "score"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), score_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = heap = own = copies = None
        out: list[tuple] = []

        def end() -> None:
            rows = heap.ranked()
            if (own, key[0]) in rows:
                rows.remove((own, key[0]))
            out.extend((key[0], copies, n + 1, i, s) for n, (s, i) in enumerate(rows[:k]))

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
            out.clear()
            return made

        for b in batches:
            for query_id, kind, m, mine, vec_id, score in zip(*(c.to_pylist() for c in b.columns)):
                if (query_id, kind) != key:
                    if key is not None:
                        end()
                    key, heap, own, copies = (query_id, kind), Heap(k + 1), mine, m
                heap.push(score, vec_id)
            if len(out) > 10_000:
                yield batch()
        if key is not None:
            end()
        if out:
            yield batch()

    return run


def search(
    vectors: DataFrame,
    id_col: str,
    vector_col: str,
    is_query: Column,
    block: Callable[[np.ndarray, np.ndarray, np.ndarray, int], tuple[list, list[tuple[int, int, float]]]],
    score_type: str,
    k: int,
    block_bytes: int = BLOCK_BYTES,
    least: int = 24,
) -> DataFrame:
    """query_id, rank, vec_id, score.

    ``block`` gets query vectors, candidate ids and vectors and a number of results, and gives each query's score
    with itself (None: no query) and (place of the query, vec_id, score) of its best.
    """
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("is_query"))
    good = good.filter(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id", "v").agg(F.count("*").alias("copies"), F.max("is_query").alias("is_query"))
    n, n_queries, width = good.agg(F.count("*"), F.count(F.when(F.col("is_query"), 1)), F.max(F.size("v"))).first()
    rows = max(64, block_bytes // (8 * max(1, width or 1)))
    q_blocks = max(1, -(-n_queries // rows))
    c_blocks = max(least, -(-n // rows))  # each block passes on k + 1 rows of each query
    deal = lambda blocks: F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries = good.filter("is_query").select("id", "v", "copies", deal(q_blocks).alias("qb"), every(c_blocks).alias("cb"))
    candidates = good.select("id", "v", "copies", deal(c_blocks).alias("cb"), every(q_blocks).alias("qb"))
    kind = pa.int64() if score_type == "long" else pa.float64()
    kinds = (pa.int64(), pa.int64(), pa.int64(), kind, pa.int64(), kind)
    names = ["query_id", "kind", "copies", "own", "vec_id", "score"]

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        rows = []
        if q.num_rows and c.num_rows:
            ids, found = fold(np.asarray(c["id"]), stack(c["v"], width), np.asarray(c["copies"]), k + 1)
            q_ids, copies = q["id"].to_pylist(), q["copies"].to_pylist()
            own, hits = block(stack(q["v"], width), ids, found, k + 1)
            hashes = q["kind"].to_pylist()
            rows = [(q_ids[at], hashes[at], copies[at], own[at], vec_id, score) for at, vec_id, score in hits]
        columns = zip(*rows) if rows else [[]] * len(names)
        give_back()
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=names)

    queries = queries.withColumn("kind", F.xxhash64("v"))
    parts = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(run, f"query_id long, kind long, copies long, own {score_type}, vec_id long, score {score_type}")
    merged = parts.repartition("query_id", "kind").sortWithinPartitions("query_id", "kind").mapInArrow(_merge(k, kind), f"query_id long, copies long, rank int, vec_id long, score {score_type}")
    return with_copies(merged, "copies")
