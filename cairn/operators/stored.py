"""BM25 over a stored index: blocks are skipped by what they can add at most.

A search reads the folders of its queries' terms. Of every block it first reads the summary
alone: the largest count and the smallest length bound each weight in it, and the sum over a
query's terms bounds what any document of a stripe can score. The stripes that promise most
are scored first; the k-th best score found there is a floor, and of the other stripes only
those whose bound reaches it are scored. So the result is that of a full search, whatever is
skipped. A stripe is scored in one group, with the queries that may find something in it.
Queries come in blocks of bounded bytes; their terms stand in the driver and in every task.

Defined cases: queries without an id, or none of whose terms is in the index, have no
results; ties go to the smaller id; fewer documents than k give fewer rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import work
from ..sources.store import Snapshot, Store, bucket_of
from . import lexical

FIRST = 4
"""Stripes of each query that are scored to find its floor."""
SLACK = 1e-9
"""Relative; far above the rounding of a sum of weights."""


def plain(rows: DataFrame) -> DataFrame:
    """Tokens without any change of form."""
    return rows.withColumn("tokens", lexical.tokens(F.col("text")))


def open_store(spark, path: str, encoder: str = "plain", **options) -> Store:
    """The index in a folder, with the encoder of that name."""
    from . import english

    return Store(spark, path, {"plain": plain, "english": english.encode}[encoder], encoder, **options)


class Search:
    """One batch of queries (qid, text) against a snapshot; its steps are DataFrames, so that tests can count what is read."""

    def __init__(self, store: Store, snapshot: Snapshot, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, avg_len: float | None = None):
        self.k, self.k1, self.b = k, k1, b
        self.avg_len = float(avg_len or snapshot.mean_length or 1.0)
        spark = store.spark
        asked = store.encode(queries.select(F.col("qid").cast("long").alias("qid"), F.coalesce("text", F.lit("")).alias("text")).filter("qid IS NOT NULL"))
        asked = asked.select("qid", F.explode("tokens").alias("term")).distinct().withColumn("bucket", bucket_of(F.col("term"), snapshot.meta["buckets"]))
        # as many numbers as there are folders
        self.buckets = sorted(r[0] for r in asked.select("bucket").distinct().collect())
        df = snapshot.terms(self.buckets).join(asked.select("term").distinct(), "term", "left_semi")
        idf = lexical.idf(F.lit(float(snapshot.n)), F.col("df"))
        # the terms of a block of queries: bounded, see search()
        self.asked = work.written(asked.join(df.select("term", idf.alias("idf")), "term").select("qid", "term", "idf"), "asked")
        terms: dict[int, list[tuple[str, float]]] = {}
        for r in self.asked.orderBy("qid", "term").collect():
            terms.setdefault(r["qid"], []).append((r["term"], r["idf"]))
        self.terms = spark.sparkContext.broadcast(terms)
        self.own = F.broadcast(self.asked.select("term").distinct())
        self.blocks = snapshot.postings(self.buckets)
        self.marks = snapshot.marks() if snapshot.meta["deletions"] else None
        most = F.col("idf") * lexical.saturation(F.col("max_tf"), F.col("min_len"), F.lit(self.avg_len), k1, b)
        # a stripe's summaries come together, once for each term, before they meet the queries that ask for it
        summaries = self.blocks.select("seg", "stripe", "term", "max_tf", "min_len").join(self.own, "term", "left_semi").repartition("seg", "stripe")
        bounds = summaries.join(F.broadcast(self.asked), "term")
        self.bounds = work.written(bounds.groupBy("qid", "seg", "stripe").agg((F.sum(most) * (1 + SLACK)).alias("most")), "bounds")
        nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("most"), "seg", "stripe"))
        self.first = self.bounds.withColumn("nth", nth).filter(F.col("nth") <= FIRST).drop("nth")
        self.first = work.written(self.first, "first")
        self.early = work.written(lexical.top_k(self.scored(self.first), k, key="id"), "early")
        # a query with fewer than k documents so far has no floor
        floor = self.early.filter(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
        later = self.bounds.join(F.broadcast(self.first.drop("most")), ["qid", "seg", "stripe"], "left_anti").join(F.broadcast(floor), "qid", "left")
        self.second = later.filter(F.col("floor").isNull() | (F.col("most") >= F.col("floor"))).select("qid", "seg", "stripe", "most")
        self.spark = spark

    def scored(self, pairs: DataFrame) -> DataFrame:
        """qid, id, score of the k best of each query in each stripe of (qid, seg, stripe)."""
        k, k1, b, mean, shared = self.k, self.k1, self.b, self.avg_len, self.terms
        asks = pairs.select(F.col("seg").alias("q_seg"), F.col("stripe").alias("q_stripe"), "qid", F.lit(None).cast("long").alias("gone"))
        if self.marks is not None:  # a row for each, whatever the number of queries
            asks = asks.unionByName(self.marks.select(F.col("seg").alias("q_seg"), F.col("stripe").alias("q_stripe"), F.lit(None).cast("long").alias("qid"), F.col("id").alias("gone")))
        held = self.blocks.select("seg", "stripe", "term", "ids", "tfs", "lens").join(self.own, "term", "left_semi")
        held = held.join(pairs.select("seg", "stripe").distinct(), ["seg", "stripe"], "left_semi")

        def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
            out: list[tuple[int, int, float]] = []
            if blocks.num_rows and queries.num_rows:
                gone = set(queries["gone"].drop_null().to_pylist())
                at: dict[str, list[int]] = {}
                for i, t in enumerate(blocks["term"].to_pylist()):
                    at.setdefault(t, []).append(i)
                flat = lambda name: np.asarray(blocks[name].combine_chunks().flatten().fill_null(-1))
                ends = np.asarray(blocks["ids"].combine_chunks().offsets)
                ends = ends - ends[0]
                ids, tfs, lens = flat("ids"), flat("tfs").astype(np.float64), flat("lens").astype(np.float64)
                every, doc = np.unique(ids, return_inverse=True)
                live = np.array([i >= 0 and i not in gone for i in every.tolist()], bool)
                weight = tfs * (k1 + 1) / (tfs + k1 * (1 - b + b * lens / mean))
                for qid in queries["qid"].drop_null().to_pylist():
                    parts = [(i, idf) for t, idf in shared.value[qid] for i in at.get(t, ())]
                    if not parts:
                        continue
                    cells = np.concatenate([doc[ends[i] : ends[i + 1]] for i, _ in parts])
                    values = np.concatenate([idf * weight[ends[i] : ends[i + 1]] for i, idf in parts])
                    sums = lexical._add_in_order(cells, values, len(every))
                    hits = np.flatnonzero((np.bincount(cells, minlength=len(every)) > 0) & live)
                    hits = hits[np.lexsort((every[hits], -sums[hits]))[:k]]
                    out += [(qid, int(every[h]), float(sums[h])) for h in hits]
            columns = zip(*out) if out else ([], [], [])
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["qid", "id", "score"])

        return held.groupBy("seg", "stripe").cogroup(asks.groupBy("q_seg", "q_stripe")).applyInArrow(run, "qid long, id long, score double")

    def result(self, key: str = "doc_id") -> DataFrame:
        found = self.early.select("qid", "id", "score").unionByName(self.scored(self.second))
        return lexical.top_k(found, self.k, key="id").select("qid", F.col("id").alias(key), "score", "rank")


def search(store: Store, queries: DataFrame, k: int = 10, snapshot: Snapshot | None = None, key: str = "doc_id", **options) -> DataFrame:
    """qid, key, score, rank of the k best documents of each query (qid, text) in the current or a given snapshot."""
    snapshot = snapshot or store.snapshot()
    # a token takes two bytes at least, with what follows it
    size = queries.select(F.sum(F.octet_length("text").cast("long") + 1).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // (2 * lexical.BLOCK_TERMS)))
    block = F.pmod(F.xxhash64(F.col("qid").cast("long")), F.lit(blocks))
    parts = [queries.filter(block == b) for b in range(blocks)] if blocks > 1 else [queries]
    return reduce(DataFrame.unionByName, (Search(store, snapshot, x, k, **options).result(key) for x in parts))
