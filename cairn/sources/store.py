"""A stored index: immutable segments of block-max postings, and numbered snapshots behind one pointer.

A segment is written once and never changed. Its forward table has a row for each document
(its terms and their counts) in stripes of STRIPE documents. Its postings are blocks, one for
each term and stripe (two, where a stripe lies across row groups of a file): the documents,
their counts and lengths, and the largest count and the smallest length among them, from which
any BM25 weight in the block is bounded whatever k1, b and the mean length are. A task makes
the blocks of a run of stripes at once and writes a row for each term of the run. Postings lie
in folders by a hash of the term, so a search reads the folders of its terms; a term in very
many documents is written by many tasks, a share of the runs each.

A document is replaced or deleted by marks: (segment, stripe, id) rows, with the counts by
term that go with them. A snapshot is a small file that names segments and marks and holds
the number and total length of live documents; df of a term is what its segments count less
what its marks take back. CURRENT names the snapshot that counts and is swapped in one
rename, so readers see the old state or the new one, and a reader that holds a snapshot goes
on reading it until ``vacuum`` removes what no kept snapshot names. A writer first claims the
snapshot it starts from; a second writer from the same one fails with Conflict.

Defined cases: a null text has no terms and counts as a document; of rows that share an id in
one batch the one with the highest version stays, then the one whose text is last in order; a row without an id
is counted in the statistics and never found, replaced or deleted; an older version than the
stored one is left out; deleting what is not there changes nothing; an index without
documents finds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work

STRIPE = 128
BUCKETS = 64
DOCS_PER_TASK = 1 << 20
"""Documents whose postings of a bucket one task writes."""
STEP_ROWS = 256
"""Documents whose tokens a task counts at once."""
RUN_POSTINGS = 1 << 21
"""Postings of a run, the stripes that a task turns over at once, if one stripe has no more."""
SENT_MARKS = 1 << 21
"""Marks that are sent to every task; more are joined by an exchange of the documents."""
MARKS = "seg int, stripe long, id long"
FORWARD = "id long, version long, len int, terms array<struct<term:string,tf:int>>"
RUNS = "term string, n long, first long, stripes array<bigint>, ends array<int>, max_tfs array<int>, min_lens array<int>, ids array<bigint>, tfs array<int>, lens array<int>"
TERMS = "bucket int, term string, n long"


class Conflict(RuntimeError):
    """Another writer has claimed or changed the snapshot that this one began with."""


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def counted(tokens: Column) -> Column:
    """array(struct(term, tf)) of an array of tokens, in order of terms: sorted, then cut where the term changes."""
    let = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)

    def runs(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        end = lambda s, j: F.coalesce(F.get(s, j + 1), F.size(t))
        some = let(starts, lambda s: F.transform(s, lambda i, j: F.struct(F.get(t, i).alias("term"), (end(s, j) - i).alias("tf"))))
        return F.when(F.size(t) > 0, some).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))

    return let(F.array_sort(tokens), runs)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, version, len, terms) of rows (id, version, tokens)."""
    for batch in batches:
        for s in range(0, batch.num_rows, STEP_ROWS):
            some = batch.slice(s, STEP_ROWS)
            lists = some.column(2)
            length = np.diff(np.asarray(lists.offsets))
            word = lists.flatten().dictionary_encode()
            row, code, tf = _cells(np.repeat(np.arange(some.num_rows), length), np.asarray(word.indices), len(word.dictionary))
            ends = pa.array(np.searchsorted(row, np.arange(some.num_rows + 1)), pa.int32())
            terms = pa.StructArray.from_arrays([word.dictionary.take(pa.array(code)), pa.array(tf, pa.int32())], names=["term", "tf"])
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(length, pa.int32()), pa.ListArray.from_arrays(ends, terms)], names=["id", "version", "len", "terms"])


def _cells(row: np.ndarray, code: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair of a row and a code once, in order, and how often it is there."""
    cell, n = np.unique(row.astype(np.int64) * max(1, codes) + code, return_counts=True)
    return *np.divmod(cell, max(1, codes)), n


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, n) of lists of terms: in how many of a batch's documents a term is."""
    for batch in batches:
        word = batch.column(0).flatten().dictionary_encode()
        n = np.bincount(np.asarray(word.indices), minlength=len(word.dictionary))
        yield pa.RecordBatch.from_arrays([word.dictionary, pa.array(n, pa.int64())], names=["term", "n"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RUNS of rows (stripe, id, len, terms) that stand in order of stripes; a task never holds much more than a batch."""
    held: list[pa.RecordBatch] = []  # of the last stripe, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        stripe, ends = np.asarray(batch.column(0)), np.asarray(batch.column(3).offsets)
        if held and held[0].column(0)[0].as_py() != stripe[0]:
            yield _turned(held)
            held = []
        starts = np.flatnonzero(np.r_[True, stripe[1:] != stripe[:-1]])
        at = 0
        while at < len(starts) - 1:  # whole stripes, of a bounded number of postings or one
            upto = int(np.searchsorted(ends[starts], ends[starts[at]] + RUN_POSTINGS, "right")) - 1
            upto = min(max(upto, at + 1), len(starts) - 1)
            yield _turned([*held, batch.slice(starts[at], starts[upto] - starts[at])])
            held, at = [], upto
        held.append(batch.slice(starts[at]))
    if held:
        yield _turned(held)


def _turned(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """A run of some whole stripes: for each term its blocks, in order of stripes, and in a block the documents in order of ids."""
    stripe, ids, lens, lists = (c.combine_chunks() for c in pa.Table.from_batches(parts).columns)
    term, tf = lists.flatten().flatten()
    word = term.dictionary_encode()
    place = np.empty(len(ids), np.int64)  # of each row
    place[np.lexsort((np.asarray(ids.fill_null(-(1 << 63))), np.asarray(stripe)))] = np.arange(len(ids))
    at = np.argsort(place)  # the row in each place
    posting = np.asarray(word.indices).astype(np.int64) * len(ids) + np.repeat(place, np.diff(np.asarray(lists.offsets)))
    order = np.argsort(posting)
    code, row = np.divmod(posting[order], max(1, len(ids)))
    row, tf = at[row], np.asarray(tf)[order]
    of, length = np.asarray(stripe)[row], np.asarray(lens)[row]
    begins = np.flatnonzero((code[1:] != code[:-1]) | (of[1:] != of[:-1])) + 1
    begins = np.r_[0, begins] if len(code) else np.zeros(0, np.int64)  # of each block
    heads = np.flatnonzero(np.r_[True, code[begins][1:] != code[begins][:-1]]) if len(code) else begins  # the first block of each term
    blocks, postings = np.r_[heads, len(begins)], np.r_[begins[heads], len(code)]
    ends = np.r_[begins[1:], len(code)][: len(begins)] - np.repeat(postings[:-1], np.diff(blocks))
    each = lambda f, x: f.reduceat(x, begins) if len(begins) else x
    of_blocks = lambda x, t=pa.int32(): pa.ListArray.from_arrays(pa.array(blocks, pa.int32()), pa.array(x, t))
    of_postings = lambda x: pa.ListArray.from_arrays(pa.array(postings, pa.int32()), x)
    columns = [word.dictionary.take(pa.array(code[begins[heads]])), pa.array(np.diff(postings), pa.int64()), pa.array(of[begins[heads]], pa.int64())]
    columns += [of_blocks(of[begins], pa.int64()), of_blocks(ends), of_blocks(each(np.maximum, tf)), of_blocks(each(np.minimum, length))]
    columns += [of_postings(ids.take(pa.array(row))), of_postings(pa.array(tf, pa.int32())), of_postings(pa.array(length, pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=["term", "n", "first", "stripes", "ends", "max_tfs", "min_lens", "ids", "tfs", "lens"])


def _unpacked(runs: DataFrame) -> DataFrame:
    """The blocks of runs; what is not asked for is not read."""
    at = lambda name: F.get(name, F.col("i"))
    begin = F.coalesce(F.get("ends", F.col("i") - 1), F.lit(0))
    own = lambda name: F.slice(name, begin + 1, at("ends") - begin).alias(name)
    each = runs.select("*", F.posexplode("stripes").alias("i", "stripe"))
    return each.select("bucket", "stripe", "term", (at("ends") - begin).alias("n"), at("max_tfs").alias("max_tf"), at("min_lens").alias("min_len"), own("ids"), own("tfs"), own("lens"))


@dataclass(frozen=True)
class Snapshot:
    """A state of the index; what it names is never changed."""

    spark: SparkSession
    path: str
    meta: dict

    @property
    def n(self) -> int:
        return self.meta["n"]

    @property
    def mean_length(self) -> float | None:
        return self.meta["total"] / self.n if self.n else None

    def _union(self, parts: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def _read(self, folder: str, buckets: list[int] | None) -> DataFrame:
        df = self.spark.read.parquet(folder)
        return df if buckets is None else df.filter(F.col("bucket").isin(buckets))

    def postings(self, buckets: list[int] | None = None) -> DataFrame:
        """seg, stripe, term, n, max_tf, min_len, ids, tfs, lens of the blocks in these buckets."""

        def own(s: dict) -> DataFrame:
            held = self._read(f"{self.path}/{s['folder']}/postings", buckets)
            # segments of an earlier form hold blocks themselves
            return (held if "stripe" in held.columns else _unpacked(held)).withColumn("seg", F.lit(s["seg"]))

        return self._union([own(s) for s in self.meta["segments"] if s["postings"]], "bucket int, seg int, stripe long, term string, n int, max_tf int, min_len int, ids array<bigint>, tfs array<int>, lens array<int>")

    def terms(self, buckets: list[int] | None = None) -> DataFrame:
        """term, df over live documents."""
        own = [self._read(f"{self.path}/{s['folder']}/terms", buckets) for s in self.meta["segments"] if s["postings"]]
        gone = [self._read(f"{self.path}/{d['folder']}/terms", buckets).withColumn("n", -F.col("n")) for d in self.meta["deletions"]]
        df = self._union([x.select("term", "n") for x in own + gone], "term string, n long")
        return df.groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0")

    def marks(self) -> DataFrame:
        """seg, stripe, id of documents that are no longer there."""
        return self._union([self.spark.read.schema(MARKS).parquet(f"{self.path}/{d['folder']}/marks") for d in self.meta["deletions"]], MARKS)

    def every(self) -> DataFrame:
        """seg, stripe, id, version, len, terms of all documents, those that are no longer there too."""
        own = lambda s: self.spark.read.parquet(f"{self.path}/{s['folder']}/docs").withColumn("seg", F.lit(s["seg"]))
        return self._union([own(s) for s in self.meta["segments"]], f"seg int, stripe long, {FORWARD}")

    def documents(self) -> DataFrame:
        """The same of live documents."""
        if not self.meta["deletions"]:
            return self.every()
        return _split(self.every(), self.marks(), sum(d["n"] for d in self.meta["deletions"]), False)


def _split(docs: DataFrame, marks: DataFrame, n: int, marked: bool) -> DataFrame:
    """The documents that n marks name, or the others. They stay in their tasks, unless there are very many marks: terms are wide."""
    by_stripe = marks.groupBy("seg", "stripe").agg(F.collect_list("id").alias("gone"))
    met = docs.join(F.broadcast(by_stripe) if n <= SENT_MARKS else by_stripe, ["seg", "stripe"], "inner" if marked else "left")
    # a row without an id is never marked
    named = F.coalesce(F.array_contains("gone", F.col("id")), F.lit(False))
    return met.filter(named if marked else ~named).drop("gone")


class Store:
    """An index in a folder. ``encode`` makes the tokens of a text column; readers must use the same."""

    def __init__(self, spark: SparkSession, path: str, encode: Callable[[DataFrame], DataFrame], encoder: str = "plain", buckets: int = BUCKETS, stripe: int = STRIPE):
        self.spark, self.path, self.encode, self.encoder, self.buckets, self.stripe = spark, path.rstrip("/"), encode, encoder, buckets, stripe

    # --- snapshots ---

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The current state, or an older one that has not been removed."""
        name = work.read_text(self.spark, f"{self.path}/CURRENT")
        if number is not None:
            name = f"snapshots/{number:08d}.json"
        text = work.read_text(self.spark, f"{self.path}/{name}") if name else None
        if text is None:
            if name and number is not None:
                raise FileNotFoundError(f"no snapshot {number} in {self.path}")
            return Snapshot(self.spark, self.path, {"number": 0, "encoder": self.encoder, "buckets": self.buckets, "n": 0, "total": 0, "next": 0, "segments": [], "deletions": [], "applied": {}})
        meta = json.loads(text)
        if meta["encoder"] != self.encoder:
            raise ValueError(f"the index was built with encoder {meta['encoder']!r}, not {self.encoder!r}")
        return Snapshot(self.spark, self.path, meta)

    def _publish(self, base: Snapshot, meta: dict) -> Snapshot:
        """The new state, unless another writer was first."""
        meta = base.meta | meta | {"number": base.meta["number"] + 1}
        name = f"snapshots/{meta['number']:08d}.json"
        try:
            work.write_text(self.spark, f"{self.path}/{name}", json.dumps(meta))
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"snapshot {meta['number']} of {self.path} is there already") from e
            raise
        pointer = f"{self.path}/CURRENT-{uuid.uuid4().hex}"
        work.write_text(self.spark, pointer, name)
        work.swap(self.spark, pointer, f"{self.path}/CURRENT")
        return Snapshot(self.spark, self.path, meta)

    def recover(self) -> Snapshot:
        """Makes the last snapshot that was written whole the current one: a writer may have died before it swapped the pointer."""
        base = self.snapshot()
        name = f"snapshots/{base.meta['number'] + 1:08d}.json"
        text = work.read_text(self.spark, f"{self.path}/{name}")
        if text is None:
            return base
        try:
            json.loads(text)
        except ValueError:  # it died while it wrote
            work.remove(self.spark, f"{self.path}/{name}")
            return base
        pointer = f"{self.path}/CURRENT-{uuid.uuid4().hex}"
        work.write_text(self.spark, pointer, name)
        work.swap(self.spark, pointer, f"{self.path}/CURRENT")
        return self.snapshot()

    # --- segments ---

    def _segment(self, seg: int, rows: DataFrame) -> dict:
        """Writes (id, version, len, terms) rows as a segment."""
        folder = f"segments/{seg:08d}-{uuid.uuid4().hex}"
        at = f"{self.path}/{folder}"
        # rows of a task stand in stripes in their order; written, so that they stay in them
        stripes = F.shiftright(F.monotonically_increasing_id(), self.stripe.bit_length() - 1)
        rows.select("id", "version", "len", "terms", stripes.alias("stripe")).write.parquet(f"{at}/docs")
        docs = self.spark.read.parquet(f"{at}/docs")
        n, total = docs.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0)).cast("long")).first()
        groups = max(1, -(-n // DOCS_PER_TASK))
        # blocks are made where their stripes are: what is dealt, sorted and written is a row for each term of a run, not for each posting
        runs = docs.select("stripe", "id", "len", "terms").mapInArrow(_runs, RUNS).withColumn("bucket", bucket_of(F.col("term"), self.buckets))
        tasks = min(self.buckets * groups, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), groups))
        place = F.col("bucket") * groups + F.pmod(F.xxhash64("first"), F.lit(groups)).cast("int")
        dealt = runs.repartitionById(tasks, F.pmod(place, F.lit(tasks))).drop("first")
        # in order of buckets alone: a search reads a folder whole, and an order of terms costs as much as their exchange
        dealt.write.partitionBy("bucket").parquet(f"{at}/postings")
        if total:
            self._write_terms(self.spark.read.parquet(f"{at}/postings").select("bucket", "term", "n"), f"{at}/terms")
        return {"seg": seg, "folder": folder, "n": n, "total": total, "postings": total > 0}

    def _write_terms(self, terms: DataFrame, path: str) -> None:
        """Writes the sums of (bucket, term, n) rows."""
        few = min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        terms.repartition(few, "bucket").groupBy("bucket", "term").agg(F.sum("n").alias("n")).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)

    def _forward(self, docs: DataFrame, key: str, version: str | None) -> DataFrame:
        """id, version, len, terms; one row for each id."""
        rows = docs.select(F.col(key).cast("long").alias("id"), (F.col(version).cast("long") if version else F.lit(0).cast("long")).alias("version"), F.coalesce("text", F.lit("")).alias("text"))
        often = rows.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1")
        if not often.isEmpty():
            last = rows.filter("id IS NOT NULL").groupBy("id").agg(F.max(F.struct(F.coalesce("version", F.lit(-(1 << 63))), "text")).alias("r"))
            named = last.select("id", F.col("r.col1").alias("version"), F.col("r.text").alias("text"))
            rows = named.unionByName(rows.filter("id IS NULL"))
        tokens = self.encode(rows)
        return tokens.select("id", "version", "tokens").mapInArrow(_counts, FORWARD)

    def _taken_back(self, base: Snapshot, ids: DataFrame) -> tuple[dict | None, int, int]:
        """Writes marks for the live documents with these ids, and what they take from df, n and total length."""
        folder = f"deletions/{uuid.uuid4().hex}"
        at = f"{self.path}/{folder}"
        # ids alone meet; terms are read once it is known whose
        base.documents().select("seg", "stripe", "id", "len").join(ids.select("id"), "id", "left_semi").select("seg", "stripe", "id", "len").write.parquet(f"{at}/rows")
        rows = self.spark.read.parquet(f"{at}/rows")
        n, total = rows.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0)).cast("long")).first()
        if not n:
            work.remove(self.spark, at)
            return None, 0, 0
        marks = rows.select("seg", "stripe", "id")
        marks.write.parquet(f"{at}/marks")
        gone = _split(base.every().select("seg", "stripe", "id", F.col("terms.term").alias("term")), marks, n, True)
        held = gone.select("term").mapInArrow(_held, "term string, n long").withColumn("bucket", bucket_of(F.col("term"), self.buckets))
        # also without a term there is a folder to read
        self._write_terms(held.unionByName(self.spark.createDataFrame([(0, "", 0)], TERMS)), f"{at}/terms")
        work.remove(self.spark, f"{at}/rows")
        return {"folder": folder, "n": n}, n, total

    # --- changes ---

    def rebuild(self, docs: DataFrame, key: str = "doc_id", version: str | None = None) -> Snapshot:
        """Replaces all that is there; readers see the old state until the new one is whole."""
        base = self.snapshot()
        made = self._segment(base.meta["next"], self._forward(docs, key, version))
        return self._publish(base, {"next": base.meta["next"] + 1, "n": made["n"], "total": made["total"], "segments": [made], "deletions": [], "buckets": self.buckets})

    def upsert(self, docs: DataFrame, key: str = "doc_id", version: str | None = None, applied: tuple[str, int] | None = None) -> Snapshot:
        """New documents, and new texts of those that are there. ``applied`` (stream, batch): a batch counts once, however often it comes."""
        base = self.snapshot()
        if applied and base.meta["applied"].get(applied[0], -1) >= applied[1]:
            return base
        rows = self._forward(docs, key, version)
        if version:
            rows = work.written(rows, "incoming")
            newer = base.documents().filter("id IS NOT NULL").select("id", F.coalesce("version", F.lit(-(1 << 63))).alias("stored"))
            rows = rows.join(newer, "id", "left").filter(F.col("stored").isNull() | (F.coalesce("version", F.lit(-(1 << 63))) >= F.col("stored"))).drop("stored")
        made = self._segment(base.meta["next"], rows)
        marks, n, total = self._taken_back(base, self.spark.read.parquet(f"{self.path}/{made['folder']}/docs"))
        meta = {"next": base.meta["next"] + 1, "n": base.n - n + made["n"], "total": base.meta["total"] - total + made["total"]}
        meta["segments"] = [*base.meta["segments"], made]
        meta["deletions"] = base.meta["deletions"] + ([marks] if marks else [])
        if applied:
            meta["applied"] = base.meta["applied"] | {applied[0]: applied[1]}
        return self._publish(base, meta)

    def delete(self, ids: DataFrame, key: str = "doc_id") -> Snapshot:
        base = self.snapshot()
        gone = ids.select(F.col(key).cast("long").alias("id")).distinct()
        marks, n, total = self._taken_back(base, gone)
        if not marks:
            return base
        return self._publish(base, {"n": base.n - n, "total": base.meta["total"] - total, "deletions": [*base.meta["deletions"], marks]})

    def compact(self) -> Snapshot:
        """One segment of what is live, without marks; texts are not read again."""
        base = self.snapshot()
        made = self._segment(base.meta["next"], base.documents())
        return self._publish(base, {"next": base.meta["next"] + 1, "n": made["n"], "total": made["total"], "segments": [made], "deletions": []})

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes what none of the last ``keep`` snapshots names, and says what; readers of older ones lose them."""
        base = self.snapshot()
        number = base.meta["number"]
        named = set()
        for i in range(max(1, number - keep + 1), number + 1):
            meta = self.snapshot(i).meta
            named |= {x["folder"] for x in meta["segments"] + meta["deletions"]} | {f"snapshots/{i:08d}.json"}
        gone = []
        for kind in ("segments", "deletions", "snapshots"):
            files, target = work.file_system(self.spark, f"{self.path}/{kind}")
            if files.exists(target):
                gone += [name for x in files.listStatus(target) if (name := f"{kind}/{x.getPath().getName()}") not in named]
        for name in gone:
            work.remove(self.spark, f"{self.path}/{name}")
        return sorted(gone)
