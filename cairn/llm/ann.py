"""Nearest neighbours by cosine through a block matrix join of int8 tiles.

Unit vectors are quantised to int8 with a scale of their own. A tile of queries times
candidates is a product of whole numbers, exact at any width; the length of what
quantisation cut off bounds its error from both sides (Cauchy-Schwarz), and a term that
grows with the width covers the rounding of doubles. Pairs whose upper bound reaches both
the k-th best lower bound of the tile and the least of the query's heap survive; only they
are recomputed in double precision on the original vectors, component after component,
and pushed on the heap. Heaps of all blocks are merged. So every true neighbour is found:
recall is 1.

Defined cases: vectors that are null, zero or hold null, NaN or infinite components, and
rows without an id, take no part; a shorter vector counts as filled up with zeros; rows
that share an id are candidates each on its own, and queries each on its own; ties go to
the smaller id; fewer candidates than k give fewer rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Heap, search

EXACT = 1024
"""So many products of two int8 numbers have a sum under 2^24, where float32 products stay whole numbers."""


def sum_in_order(x: np.ndarray) -> np.ndarray:
    """Sum over the last axis, first component first."""
    out = np.zeros(x.shape[:-1])
    for d in range(x.shape[-1]):
        out = out + x[..., d]
    return out


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, lengths of the kept and the cut-off part."""
    scale = np.maximum(np.abs(unit).max(axis=1, keepdims=True, initial=0), 1e-300) / 127.0
    codes = np.rint(unit / scale).astype(np.int8)
    kept = codes * scale
    return codes, scale[:, 0], np.linalg.norm(kept, axis=1), np.linalg.norm(unit - kept, axis=1)


def tile_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows, as doubles: by slices of dimensions in which float32 holds every sum."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], EXACT):
        out += a[:, d : d + EXACT].astype(np.float32) @ b[:, d : d + EXACT].astype(np.float32).T
    return out


def _scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors times a power of two, which is exact and keeps squares of tiny or huge components in range, and their lengths."""
    most = np.maximum(np.abs(v).max(axis=1, keepdims=True, initial=0), 1e-300)
    v = v * np.exp2(-np.floor(np.log2(most)))
    return v, np.sqrt(sum_in_order(v * v))


def block_neighbours(q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int, tile: int = 1024) -> tuple[list, list[tuple[int, int, float]]]:
    q, q_norm = _scaled(q)
    c, c_norm = _scaled(c)
    ids, c, c_norm = (x[c_norm > 0] for x in (ids, c, c_norm))
    places = np.flatnonzero(q_norm > 0)
    own = [float(s / (m * m)) if m > 0 else None for s, m in zip(sum_in_order(q * q), q_norm)]
    heaps = {int(i): Heap(k) for i in places}
    slack = 1e-15 * (c.shape[1] + 64)
    unit = q[places] / q_norm[places, None]
    q_code, q_scale, q_len, q_cut = quantise(unit)
    for t in range(0, len(ids), tile):
        some = slice(t, t + tile)
        c_ids, c_in, c_long = ids[some], c[some], c_norm[some]
        c_code, c_scale, c_len, c_cut = quantise(c_in / c_long[:, None])
        kk = min(k, len(c_ids))
        for s in range(0, len(places), 256):
            rows = slice(s, s + 256)
            near = tile_product(q_code[rows], c_code) * q_scale[rows, None] * c_scale
            error = q_cut[rows, None] * (c_len + c_cut) + q_len[rows, None] * c_cut + slack
            low = near - error
            floor = np.partition(low, len(c_ids) - kk, axis=1)[:, len(c_ids) - kk]
            for at, high, least in zip(places[rows].tolist(), near + error, floor):
                heap = heaps[at]
                may = np.flatnonzero(high >= max(least, heap.least()))
                exact = sum_in_order(c_in[may] * q[at]) / (c_long[may] * q_norm[at])
                for score, vec_id in zip(exact.tolist(), c_ids[may].tolist()):
                    heap.push(score, vec_id)
    return own, [(at, vec_id, score) for at, heap in heaps.items() for score, vec_id in heap.ranked()]


def neighbours(vectors: DataFrame, is_query=None, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k largest cosines."""
    is_query = F.col(id_col) % 50 == 0 if is_query is None else is_query
    return search(vectors, id_col, vector_col, is_query, block_neighbours, "double", k)
