"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint bit is 1 if it is set in over half of the 64-bit hashes of a text's 3-word
shingles. Two fingerprints link at ``distance`` 3 or fewer differing bits. Cut into 2
segments of 32 bits, such a pair has a segment in which they differ by one bit at most,
so the two agree on that segment with one position blanked: each fingerprint is indexed
under its 64 one-wildcard variants, equal variants meet, and members are verified on all
64 bits. Every link is found.

Copies fall together before: only distinct fingerprints are indexed. A variant that many
share is cut again by the same rule: its members agree on 31 bits, the other 33 differ in
3 at most, so their one-wildcard variants in 2 segments meet in groups of at most 2^17
fingerprints. Within a group a walk over its members gives a spanning forest, never all
pairs. Labels then spread over these links by large-star and small-star rounds, all distributed.

Defined cases: null, empty and blank texts have fingerprint 0 and link like any other;
fewer than 3 words make one shingle; rows that share a doc_id are one node of the graph
if their texts agree or not (the component joins them); a null doc_id never is the name
of a component with other members, and has null if alone; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, files_for, materialize, partitions, tasks_for

SEED = 42
MOST_MANY = 100_000
"""Variants of 12 bytes each that are broadcast."""


def fingerprint(text: str | None, k: int = 3, part: int = 1 << 16) -> int:
    """Unsigned 64 bits; works through long texts in parts of so many shingles."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    last = ends[np.minimum(np.arange(n) + k - 1, len(words) - 1)].tolist()
    first = starts[:n].tolist()
    digest = xxhash.xxh64_intdigest
    count = np.zeros(64, np.int64)
    for at in range(0, n, part):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + part], last[at : at + part])], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in ``carry`` and fp, the fingerprint as a signed long, of every row."""
    n_own = 1 + len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x) for x in batch.column(n_own).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_own], pa.array(fp, pa.int64())], names=["doc_id", *carry, "fp"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *carry))
    return docs.select("doc_id", *carry, F.col("text").alias("words")).mapInArrow(run, f"{kinds}, fp long")


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between distinct fingerprints that connect all within the distance: fewer than there are members.

    Walks from member to member; each step compares one with all not yet reached.
    """
    left = np.unique(fps)
    a_out, b_out = [], []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            here = reached.pop()
            near = np.bitwise_count(left ^ here) <= distance
            if near.any():
                new, left = left[near], left[~near]
                a_out.append(np.full(len(new), here, np.uint64))
                b_out.append(new)
                reached += list(new)
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(a_out or none), np.concatenate(b_out or none)


def _forests(distance: int):
    """Maps sorted rows (key columns, then fp) to the links a, b within each key; what a batch cuts waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(columns: list[np.ndarray], upto: int) -> Iterator[pa.RecordBatch]:
            keys, fp = [c[:upto] for c in columns[:-1]], columns[-1][:upto].view(np.uint64)
            new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
            start = np.flatnonzero(new)
            stop = np.r_[start[1:], upto]
            found = [forest(fp[i:j], distance) for i, j in zip(start, stop) if j - i > 1]
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        rest = None
        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            if not len(columns[0]):
                continue
            columns = columns if rest is None else [np.concatenate(x) for x in zip(rest, columns)]
            other = np.flatnonzero(np.any([c != c[-1] for c in columns[:-1]], axis=0))
            upto = int(other[-1]) + 1 if len(other) else 0
            if upto:
                yield from done(columns, upto)
            rest = [c[upto:] for c in columns]
        if rest is not None:
            yield from done(rest, len(rest[0]))

    return run


def _variants(fp, positions: list[list[int]]):
    """An array of structs (segment, position, rest) of the one-wildcard variants within each list of bit positions."""
    keys = []
    for s, bits in enumerate(positions):
        whole = sum(1 << b for b in bits)
        for b in bits:
            mask = whole & ~(1 << b)
            keys.append(F.struct(F.lit(s * 64 + b).cast("int").alias("cut"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("rest")))
    return F.array(*keys)


def links(distinct: DataFrame, distance: int = 3, hot: int = 4096) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all within the distance."""
    if distance > 3:
        raise ValueError("two segments with one wildcard each find up to 3 differing bits")
    halves = [list(range(32)), list(range(32, 64))]
    # distinct fingerprints are few bytes in few files; their variants are many rows
    spread = distinct.select("fp").repartition(partitions(distinct.sparkSession), "fp")
    variants = lambda df: df.select("fp", F.explode(_variants(F.col("fp"), halves)).alias("v")).select("fp", "v.cut", "v.rest")
    # which variants very many share is found in a share of all fingerprints; it changes how they are compared, not what is found
    share = max(1, hot // 64)
    some = spread.filter(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0)
    many = materialize(variants(some).groupBy("cut", "rest").agg(F.count("*").alias("n")).filter(F.col("n") > hot // share).select("cut", "rest"), "many")
    n_many = many.count()
    many = F.broadcast(many) if n_many <= MOST_MANY else many
    keyed = variants(spread)
    few = keyed.join(many, ["cut", "rest"], "left_anti") if n_many else keyed
    # counted in the exchange that brings equal variants together; most stand alone and go no further
    alike = Window.partitionBy("cut", "rest")
    members = materialize(few.withColumn("n", F.count("*").over(alike)).filter("n > 1"), "members")

    def within(rows: DataFrame, *keys: str) -> DataFrame:
        rows = rows.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)
        return rows.mapInArrow(_forests(distance), "a long, b long")

    found = within(members, "cut", "rest")
    if n_many:
        # their members again, by one-wildcard variants of the 33 bits in which they may differ
        again = keyed.join(many, ["cut", "rest"], "left_semi").select("cut", "rest", "fp").mapInArrow(_cut_again, "cut int, rest long, sub int, more long, fp long")
        found = found.union(within(again, "cut", "rest", "sub", "more"))
    return found.distinct()


def _second_bits(b: int) -> list[list[int]]:
    """The blanked position and the other half, in two segments."""
    free = [b, *(range(32, 64) if b < 32 else range(32))]
    return [free[:17], free[17:]]


def _cut_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cut, rest, fp = (np.asarray(c) for c in batch.columns)
        for own in np.unique(cut):
            c, r, f = (x[cut == own] for x in (cut, rest, fp))
            for s, bits in enumerate(_second_bits(int(own) % 64)):
                whole = sum(1 << b for b in bits)
                for b in bits:
                    mask = np.uint64(whole & ~(1 << b))
                    more = (f.view(np.uint64) & mask).view(np.int64)
                    sub = np.full(len(f), s * 64 + b, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c.astype(np.int32), r, sub, more, f)], names=["cut", "rest", "sub", "more", "fp"])


def components(edges: DataFrame, most_rounds: int = 60, files: int | None = None) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of the links a, b; large-star and small-star."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        # (centre, neighbour): both directions, or to the smaller ones only
        if large:
            pairs = e.union(e.select("b", "a"))
        else:
            pairs = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        joined = pairs.join(low, pairs.a == low.c)
        if large:
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.filter("c != m").select(F.col("c").alias("a"), F.col("m").alias("b"))).distinct()

    now = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", files)
    mark, files = None, files_for(now.count())
    for _ in range(most_rounds):
        now = materialize(star(star(now, True), False), "stars", files)
        # at the fixed point every edge goes from a node to its root; the sums tell when nothing moves
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = new
    raise RuntimeError(f"no fixed point in {most_rounds} rounds")


def _roots(prints: DataFrame, distance: int) -> DataFrame:
    """fp, the least doc_id that has it, and the root of its component."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct", tasks_for(prints))
    # rows that share an id but not a text hold their fingerprints together
    apart = prints.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("z"))
    apart = apart.filter("b != z").select("doc_id", "b")
    same = prints.join(apart, "doc_id").select(F.col("fp").alias("a"), "b")
    roots = materialize(components(links(distinct, distance).union(same), files=files_for(distinct.count())), "roots")
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    prints = materialize(fingerprints(docs), "fingerprints")
    named = _roots(prints, distance)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = materialize(named.join(least, "root").select(F.col("fp").alias("own"), "component_id"), "names", tasks_for(prints))
    # one fingerprint may be that of a third of all rows: AQE splits such a partition of this join
    out = prints.join(names, prints.fp == names.own)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, carry: tuple[str, ...], distance: int = 3) -> DataFrame:
    """doc_id and the columns named in ``carry`` of one row of each component: the smallest doc_id (null last), ties by a hash of the columns."""
    # texts are moved once; rows alike in all columns fall together before that
    keyed = docs.select("doc_id", "text", *(c for c in carry if c != "text"))
    keyed = keyed.withColumns({"id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "orphan": F.col("doc_id").isNull(), "tie": F.xxhash64(*carry)})
    own = ["id", "orphan", "tie"]
    prints = materialize(fingerprints(keyed, tuple(own)), "fingerprints")
    named = _roots(prints, distance).select("fp", "root")
    least = prints.groupBy("fp").agg(F.min(F.struct("orphan", "doc_id", "tie", "id")).alias("first"))
    kept = least.join(named, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.id", "first.orphan", "first.tie")
    return keyed.dropDuplicates(own).join(kept, own, "left_semi").select("doc_id", *carry)
