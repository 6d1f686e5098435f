"""Vector code compression: product quantisation trained by Elkan's Lloyd over whole numbers.

A vector is cut into parts; each part position has a codebook. Every part keeps an upper
bound of its distance to its entry and a lower bound to every entry of its codebook, and
these are written with the rows after each round. When entries have moved, bounds move by
as much; an entry is looked at only where neither its lower bound nor half the distance
between it and the part's own entry lies strictly above the upper bound. What is looked at
is measured exactly in whole numbers, so ties go to the smaller index as in a full search.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part,
nor do those of another width than the one with the smallest vec_id whose width is a
multiple of the number of parts; components are cut to 2^27; rows that share an id count
each on its own, and rows without an id come last in the order of ids; with fewer vectors
than entries a codebook has as many entries as there are vectors; errors of rows with
equal labels are added, null labels together; no vectors give no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import usable
from .common import give_back
from .lloyd import lists, matrix, means, root_down, root_up, squared, stored, sums, whole

TILE = 512
"""Rows whose bounds are worked on at a time."""
MOST_LABELS = 100_000
"""So many sums by label are broadcast; more are joined by a shuffle."""


def _down32(x: np.ndarray) -> np.ndarray:
    f = x.astype(np.float32)
    return np.where(f > x, np.nextafter(f, np.float32(-np.inf)), f)


class Books:
    """Codebooks (part, entry, component) and the distances that prune."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        apart = squared(entries[:, :, None], entries[:, None]) if entries.size else np.zeros((*entries.shape[:2], entries.shape[1]), np.int64)
        self.half = root_down(apart) / 2
        own = np.arange(entries.shape[1])
        far = self.half.copy()
        far[:, own, own] = np.inf
        self.nearest = far.min(axis=2, initial=np.inf)
        self.moved = None if before is None else root_up(squared(entries, before))

    def first(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries, upper and lower bounds of parts (row, part, component), by all distances."""
        d = (v * v).sum(-1)[..., None] + (self.entries * self.entries).sum(-1) - 2 * np.einsum("npd,ped->npe", v, self.entries)
        a = d.argmin(axis=2)
        return a, root_up(np.take_along_axis(d, a[..., None], 2)[..., 0]), _down32(root_down(d))

    def again(self, v: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same after the entries moved, and how many distances were computed."""
        part = np.broadcast_to(np.arange(v.shape[1]), a.shape)
        lower = np.maximum(_down32(lower.astype(np.float64) * (1 - 1e-12) - self.moved), np.float32(0))
        upper = (upper + self.moved[part, a]) * (1 + 1e-12)
        computed = 0
        row, col = np.nonzero(upper >= self.nearest[part, a])
        if len(row):
            v1, a1, low = v[row, col], a[row, col], lower[row, col]
            entry = np.arange(low.shape[1])
            may = lambda at: (low[at] <= upper[row[at], col[at], None]) & (self.half[col[at], a1[at]] <= upper[row[at], col[at], None]) & (entry != a1[at, None])
            at = np.flatnonzero(may(np.arange(len(row))).any(axis=1))
            # the bound to the own entry is made exact first; that alone ends most searches
            own = squared(v1[at], self.entries[col[at], a1[at]])
            upper[row[at], col[at]] = root_up(own)
            low[at, a1[at]] = _down32(root_down(own))
            n, e = np.nonzero(may(at))
            d = squared(v1[at[n]], self.entries[col[at[n]], e])
            low[at[n], e] = _down32(root_down(d))
            computed = len(at) + len(n)
            best = np.full((len(at), low.shape[1]), np.iinfo(np.int64).max)
            best[np.arange(len(at)), a1[at]] = own
            best[n, e] = d
            found = best.argmin(axis=1)
            a[row[at], col[at]] = found
            upper[row[at], col[at]] = root_up(best[np.arange(len(at)), found])
            lower[row, col] = low
        return a, upper, lower, computed

    def error(self, v: np.ndarray, a: np.ndarray) -> np.ndarray:
        return squared(v, self.entries[np.arange(v.shape[1]), a]).sum(axis=1)


def _assign(books, parts: int, width: int, last: bool):
    """Rows with bounds to rows with the bounds of the next round, or to codes and errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Books = books.value
        entries = known.entries.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                b = batch.slice(at, TILE)
                v = matrix(b["v"], width).reshape(b.num_rows, parts, width // parts)
                if known.moved is None:
                    a, upper, lower = known.first(v)
                else:
                    a = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint16).reshape(b.num_rows, parts).astype(np.int64)
                    lower = np.frombuffer(b"".join(b["lower"].to_pylist()), np.float32).reshape(b.num_rows, parts, entries)
                    a, upper, lower, _ = known.again(v, a, matrix(b["upper"], parts, np.float64).copy(), lower)
                if last:
                    codes = ["".join(f"{x:02x}" for x in row) for row in a.tolist()]
                    yield pa.RecordBatch.from_arrays([b["id"], b["label"], pa.array(codes, pa.string()), pa.array(known.error(v, a))], names=["id", "label", "code", "error"])
                else:
                    code = pa.array([x.tobytes() for x in a.astype(np.uint16)], pa.binary())
                    low = pa.array([x.tobytes() for x in lower], pa.binary())
                    yield pa.RecordBatch.from_arrays([b["id"], b["label"], b["v"], code, lists(upper), low], names=["id", "label", "v", "code", "upper", "lower"])
        give_back()

    return run


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    good = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).filter(usable(F.col("v")))
    first = good.filter((F.size("v") > 0) & (F.size("v") % parts == 0)).orderBy(F.col("id").asc_nulls_last(), F.size("v")).select(F.size("v")).first()
    width = first[0] if first else parts
    kept = good.filter(F.size("v") == width).withColumn("v", whole("v"))
    start = [r["v"] for r in kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    book = np.array(start, np.int64).reshape(len(start), parts, width // parts).transpose(1, 0, 2)
    size = book.shape[1]

    kind = lambda name: kept.schema[name].dataType.simpleString()
    own = f"id {kind('id')}, label {kind('label')}"
    bounds = f"{own}, v array<int>, code binary, upper array<double>, lower binary"
    before, state, path = None, kept, None

    def slots_of(b: pa.RecordBatch):
        code = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint16).reshape(b.num_rows, parts).astype(np.int64)
        slot = code + np.arange(parts) * size
        return slot.ravel(), matrix(b["v"], width).reshape(-1, width // parts)

    for _ in range(rounds if size else 0):
        shared = spark.sparkContext.broadcast(Books(book, before))
        state, path = stored(state.mapInArrow(_assign(shared, parts, width, last=False), bounds), "codes", path)
        before = book
        n, total = sums(state, parts * size, width // parts, ["v", "code"], slots_of)
        book = means(book.reshape(parts * size, -1), n, total).reshape(book.shape)
    shared = spark.sparkContext.broadcast(Books(book, before))
    coded, _ = stored(state.mapInArrow(_assign(shared, parts, width, last=True), f"{own}, code string, error long"), "coded", path)

    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    by_label, _ = stored(coded.groupBy("label").agg(F.sum("error").cast("long").alias("label_error")).withColumnRenamed("label", "of_label"), "labels")
    if by_label.count() <= MOST_LABELS:
        by_label = F.broadcast(by_label)
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
    return out.select(F.col("id").alias("vec_id"), "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
