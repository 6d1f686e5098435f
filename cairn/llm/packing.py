"""Best-two-fit packing of documents into sequences.

A document is its ids and an end id; only longer ones are cut, so that all pieces but
the first are full. What is left to place are pieces of 1..capacity tokens, and pieces
of one length are alike: the plan needs only how many there are of each length, at most
``capacity`` numbers however large the corpus. The driver fills patterns of lengths
greedily, largest first, then exchanges a pattern's smallest length for the two unpacked
lengths that fill the widened gap more tightly, and repeats the pattern as often as the
counts allow. Each pattern uses up a length (or leaves too few for another use), so the
plan stays within a few times ``capacity`` rows.

Pieces find their places by their rank among pieces of the same length. Ranks come from
counts by (length, salt) with the salt a hash of the row, so one very common length is
spread over many tasks; no task sees a whole length.

Defined cases: a null text is empty and packs as the end id alone; repeated rows are
packed each on its own; a null doc_id is kept; no rows give no rows; other columns are
ignored. Which of several equal pieces takes which place follows (doc_id, piece).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import byte_batches, default_vocabulary, encoder


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary=None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all documents; ids never leave the task."""
    json_path, rank_path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(json_path, rank_path)
        for doc_ids, _, texts in byte_batches(batches):
            out = []
            for row, text in enumerate(texts):
                raw = np.append(enc.ids(text), np.uint32(end_id)).astype("<u4").tobytes()
                size = len(raw) // 4
                start, stop, n = 0, size % capacity or capacity, 0
                while start < size:
                    out.append((row, n, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])))
                    start, stop, n = stop, stop + capacity, n + 1
            if out:
                row, *rest = zip(*out)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(row)), *(pa.array(c, k) for c, k in zip(rest, kinds))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) of each pattern; the lengths of a pattern sum to capacity at most."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    out = []
    while True:
        have = np.flatnonzero(left)
        if not have.size:
            return out
        used: dict[int, int] = {}
        take = lambda s, n=1: used.__setitem__(s, used.get(s, 0) + n)
        free = lambda s: int(left[s]) - used.get(s, 0)
        gap, items = capacity, []
        k = len(have) - 1
        while k >= 0 and gap:
            s = int(have[k])
            if s > gap:
                k = int(np.searchsorted(have, gap, "right")) - 1
                continue
            n = min(free(s), gap // s)
            if n <= 0:
                k -= 1
                continue
            take(s, n)
            items += [s] * n
            gap -= n * s
        need = dict(used)
        if gap and len(items) > 1:
            small = items[-1]
            room = gap + small
            used[small] -= 1
            best = (small, None)
            ok = [int(s) for s in have if s < room and free(int(s)) > 0]
            i, j = 0, len(ok) - 1
            while i <= j:
                two = ok[i] + ok[j]
                if two > room:
                    j -= 1
                    continue
                if two > best[0] and (i != j or free(ok[i]) > 1):
                    best = (two, (ok[i], ok[j]))
                    if two == room:
                        break
                i += 1
            if best[1]:
                items[-1:] = [best[1][1], best[1][0]]
                for s in best[1]:
                    take(s)
            else:
                take(small)
        # as often as all that was chosen from is still there
        times = 1 + min((int(left[s]) - max(n, need.get(s, 0))) // n for s, n in used.items() if n)
        for s, n in used.items():
            left[s] -= n * times
        out.append((times, items))


def places(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset) of each run of places."""
    rows = []
    taken: dict[int, int] = {}
    first = 0
    for times, items in patterns:
        offset = 0
        for s in items:
            rank = taken.get(s, 0)
            rows.append((s, rank, rank + times, first, offset))
            taken[s] = rank + times
            offset += s
        first += times
    return rows


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary=None, rows_per_salt: int = 1_000_000) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    cut = materialize(pieces(docs, capacity, end_id, vocabulary), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    # a few times capacity rows of numbers, however large the corpus: a proven bound
    runs = docs.sparkSession.createDataFrame(places(plan(counts, capacity)), "at_length long, first_rank long, end_rank long, first_sequence long, offset long")
    salts = max(256, -(-max(counts.values(), default=0) // rows_per_salt))

    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    per = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = per.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    inner = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(inner) - 1).join(before, ["length", "salt"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*names, (F.col("before") + F.col("own")).alias("rank"))

    rank = F.col("rank")
    at = (F.col("length") == F.col("at_length")) & (rank >= F.col("first_rank")) & (rank < F.col("end_rank"))
    return ranked.join(F.broadcast(runs), at).select(*names, (F.col("first_sequence") + rank - F.col("first_rank")).alias("sequence_id"), "offset")
