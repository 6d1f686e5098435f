"""Exact top-k by inner product over an impact-ordered index, a score at a time.

Components become whole numbers, floor(256 x). In each block of candidates a dimension's
values are taken relative to their median and quantised in steps; a posting segment lists
the vectors with one quantised impact in one dimension. Segments are processed by falling
impact, each for all queries of a tile that are still open: impact times the query's
component is added to the accumulators of the listed vectors. What the segments not yet
read can still add to or take from any vector, and what quantisation cut off, bounds every
score from both sides. When these bounds have shrunk enough, the vectors that can still be
among a query's k best are counted, and a query stops on this proof alone: all others are
out. Possible members are rescored exactly on the whole numbers, so that stopping early
never changes a result.

Defined cases: vectors that are null or hold null, NaN or infinite components, and rows
without an id, take no part; a shorter vector counts as filled up with zeros; rows that
share an id are candidates each on its own, and queries each on its own; ties go to the
smaller id; fewer candidates than k give fewer rows; other columns are ignored. Whole
numbers and scores of any size are exact; a score among the best that doesn't fit 64
bits (a query's with itself included), or a component whose 256-fold isn't finite, is an OverflowError.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import best, search

FEW = 64
LEVELS = 64
TILE = 256


def whole(v: np.ndarray) -> np.ndarray:
    """floor(256 x): 64-bit numbers, or Python's where one needs more."""
    with np.errstate(over="ignore"):
        w = np.floor(256.0 * v)
    if not np.isfinite(w).all():
        raise OverflowError("256 times a component is not finite")
    if np.abs(w).max(initial=0) < 2**62:
        return w.astype(np.int64)
    return np.array([[int(x) for x in row] for row in w], object).reshape(w.shape)


def _most(v: np.ndarray) -> int:
    return max(abs(int(v.max())), abs(int(v.min()))) if v.size else 0


class ImpactIndex:
    """Posting segments (dimension, quantised impact) of a block of whole-number vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        n, self.width = vectors.shape
        self.ids, self.vectors = ids, vectors
        values = vectors.astype(np.float64)
        base = np.floor(np.median(values, axis=0)) if n else np.zeros(self.width)
        away = values - base
        size = np.abs(away)
        # steps are whole: numbers of usual size have steps of a few, and a step of 1 cuts nothing off
        self.step = np.maximum(np.ceil(size.max(axis=0, initial=0) * (1 + 1e-12) / levels), 1.0)
        self.error = (self.step - 1) / 2
        code = (np.sign(away) * np.minimum(np.ceil(size / self.step), levels)).astype(np.int8)
        self.most = np.stack([code.max(axis=0, initial=0), -code.min(axis=0, initial=0)]).astype(np.float64)  # the levels above and below the median
        # impact, dimension and vectors of each segment, largest level first
        self.segments: list[tuple[int, float, int, np.ndarray]] = []
        for d in range(self.width):
            order = np.argsort(code[:, d], kind="stable")
            kinds, start = np.unique(code[order, d], return_index=True)
            for c, at, to in zip(kinds.tolist(), start, [*start[1:], n]):
                if c:
                    middle = (abs(c) - 1) * self.step[d] + (self.step[d] + 1) / 2
                    self.segments.append((abs(c), float(np.sign(c) * middle), d, order[at:to]))
        self.segments.sort(key=lambda s: (-s[0], s[2], s[1]))
        self.largest = np.abs(values).max(axis=0, initial=0) + np.abs(base)
        self.read = self.total = 0

    def search(self, queries: np.ndarray, k: int, few: int = FEW) -> list[list[tuple[int, int]]]:
        """(vec_id, score) of the k best for each query of whole numbers."""
        n = len(self.ids)
        out: list[list[tuple[int, int]]] = [[] for _ in queries]
        if not n:
            return out
        kk = min(k, n)
        for t in range(0, len(queries), TILE):
            open_ = np.arange(t, min(t + TILE, len(queries)))
            q = queries[open_].astype(np.float64).T  # dimensions x queries
            size = np.abs(q)
            # rounding of doubles: nothing for whole numbers of usual size
            noise = 2.0**-50 * (self.width + 8) * (self.largest @ size)
            score = np.zeros((n, len(open_)))
            self.total += len(self.segments) * len(open_)
            tested = np.inf
            levels = [s[0] for s in self.segments]
            for at, (level, impact, d, rows) in enumerate(self.segments):
                score[rows] += impact * q[d]
                self.read += len(open_)
                if at + 1 < len(levels) and levels[at + 1] == level:
                    continue
                # all down to this level is read: how far a score may lie from its accumulator, above and below
                left = np.maximum(np.minimum(self.most, level - 1) * self.step, self.error)
                bound = left.sum(axis=0) @ size + 2 * noise
                last = at + 1 == len(levels)
                if not last and bound.max() > 0.8 * tested:
                    continue
                tested = bound.max()
                floor = np.partition(score, n - kk, axis=0)[n - kk]
                may = score >= floor - bound * (1 + 1e-9)
                done = (may.sum(axis=0) <= max(few, 4 * k)) | last
                for i in np.flatnonzero(done).tolist():
                    out[open_[i]] = self._rescored(np.flatnonzero(may[:, i]), queries[open_[i]], k)
                if done.any():
                    open_, q, size, noise, score = open_[~done], q[:, ~done], size[:, ~done], noise[~done], np.ascontiguousarray(score[:, ~done])
                    if not len(open_):
                        break
            for i in open_ if not self.segments else ():
                out[i] = self._rescored(np.arange(n), queries[i], k)
        return out

    def _rescored(self, rows: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        exact = product(self.vectors[rows], q)
        return [(int(self.ids[rows[i]]), int(exact[i])) for i in best(exact, self.ids[rows], k)]


def product(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers of any size."""
    if v.dtype != object and q.dtype != object and _most(v) * _most(q) * max(1, len(q)) < 2**62:
        return v @ q
    return np.array([sum(int(a) * int(b) for a, b in zip(row, q)) for row in v], object)


def block_top(q: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[list, list[tuple[int, int, int]]]:
    queries = whole(q)
    own = [int(product(row[None], row)[0]) for row in queries]
    found = [(at, vec_id, score) for at, hits in enumerate(ImpactIndex(ids, whole(vectors)).search(queries, k)) for vec_id, score in hits]
    if any(abs(s) >= 2**63 for _, _, s in found):
        raise OverflowError("a score does not fit 64 bits")
    return [x if x < 2**63 else None for x in own], found


def top_k(vectors: DataFrame, is_query=None, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k highest inner products of each query's whole-number vector."""
    is_query = F.col(id_col) % 50 == 0 if is_query is None else is_query
    return search(vectors, id_col, vector_col, is_query, block_top, "long", k)
