"""What the two Lloyd operators share: whole-number vectors, safe bounds, stored states, sums by entry.

Components become floor(256 x). Distances are exact whole numbers; bounds are roots of them,
rounded to the safe side, so a bound never excludes an entry that is as near. A state (rows
with their bounds) is written to the shared folder after each round and read by the next:
a lost executor costs its tasks only. Sums by entry are made in each task, then added by
Spark; the driver sees the entries alone, whose number is a parameter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, remove_at_exit, work_dir

MOST = 1 << 27
"""Components are cut to this, so that squared distances of up to 64 of them stay in 64 bits."""
SLACK = 1e-14


def whole(column: str, by: int = 256):
    """floor(by * x) of each component, x as a double."""
    return F.transform(column, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.lit(float(by)) * x.cast("double")))).cast("int"))


def matrix(column: pa.Array, width: int, kind=np.int64) -> np.ndarray:
    """Lists of one length as rows."""
    return np.asarray(column.flatten()).astype(kind, copy=False).reshape(-1, width)


def lists(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, max(1, rows.shape[1]), dtype=np.int32)[: len(rows) + 1], pa.array(rows.ravel()))


def root_up(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + SLACK)


def root_down(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - SLACK)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows that stand beside one another."""
    d = a - b
    return (d * d).sum(axis=-1)


def stored(df: DataFrame, name: str, before: str | None = None) -> tuple[DataFrame, str]:
    """The rows, written to the shared folder, and where; the state before is removed then."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    df.write.parquet(path)
    if before:
        remove(spark, before)
    return spark.read.schema(df.schema).parquet(path), path


def sums(state: DataFrame, slots: int, width: int, columns: list[str], slots_of) -> tuple[np.ndarray, np.ndarray]:
    """Rows and component sums of each slot; ``slots_of`` gives a batch's slots and the vectors that fall into them.

    The result has ``slots`` times ``width`` numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(slots, np.int64), np.zeros((slots, width), np.int64)
        for b in batches:
            slot, vectors = slots_of(b)
            n += np.bincount(slot, minlength=slots)
            order = np.argsort(slot, kind="stable")
            found, start = np.unique(slot[order], return_index=True)
            if len(found):
                total[found] += np.add.reduceat(vectors[order], start, axis=0)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), lists(total[used])], names=["slot", "n", "total"])

    parts = state.select(*columns).mapInArrow(run, "slot int, n long, total array<long>")
    added = parts.select("slot", "n", F.posexplode("total").alias("place", "x")).groupBy("slot", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    n, total = np.zeros(slots, np.int64), np.zeros((slots, width), np.int64)
    for r in added.collect():
        n[r["slot"]], total[r["slot"], r["place"]] = r["n"], r["x"]
    return n, total


def means(old: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """floor(sum / count); entries without rows stay."""
    return np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], old)
