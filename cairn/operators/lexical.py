"""An inverted index as DataFrames, and BM25 over it.

A term is the string itself. Searches tokenise the corpus once, count the terms the
queries ask for in the document's own row and write these counts. Once their frequencies
are known, a document is scored for all queries of a block in its own task, and each task
passes on its k best of each query: what is shuffled does not grow with the corpus or with
queries times documents. Blocks of queries are bounded; more take more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import annotate_query
from ..sources import work

SPLITTER = r"[^\p{L}\p{N}_]+"
BLOCK_TERMS = 1_000_000
"""Terms of all queries of a block, repeats over queries included."""
STEP_ROWS = 256
"""Documents whose terms a task turns over at once."""
MOST_PAIRS = 1 << 18
"""Pairs of a posting and a query that a task looks at in one step."""
EVERY = ""
"""Stands in every document, once; tokens are never empty."""


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLITTER, -1), lambda t: t != "")


def query_terms(text: Column, bands: bool = False) -> Column:
    """Each term once; a query's own counts don't matter."""
    return F.array_distinct(tokens(annotate_query(text) if bands else text))


def index(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Postings (key, term, tf, len) and statistics (n, avg_len in one row) of one scan and one exchange, counts combined before it."""
    rows = docs.select(key, tokens(F.col("text")).alias("t"))
    rows = rows.select(key, F.size("t").cast("long").alias("len"), F.explode(F.concat("t", F.array(F.lit(EVERY)))).alias("term"))
    # a condition on what is aggregated stays above the exchange, so that both results share it
    tf = rows.groupBy(key, "term", "len").agg(F.count("*").alias("tf"), F.max(F.col("term") == EVERY).alias("every"))
    once = F.when(F.col("every"), F.col("tf"))
    stats = tf.agg(F.coalesce(F.sum(once), F.lit(0)).alias("n"), F.try_divide(F.sum(once * F.col("len")), F.sum(once)).alias("avg_len"))
    return tf.filter(~F.col("every")).select(key, "term", "tf", "len"), stats


def postings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, term, tf, len: one exchange, with counts combined before it."""
    return index(docs, key)[0]


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_idf(index: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf; N is applied at query time, so it stays right as documents come in."""
    return _with_idf(index.groupBy("term").agg(F.count("*").alias("df")), stats.select("n"))


def _with_idf(df: DataFrame, n: DataFrame) -> DataFrame:
    return df.join(F.broadcast(n), how="cross").select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def corpus_idf(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same of a corpus, without its postings: terms are made distinct in a row, and counts combined before their exchange.

    Rows that share a key and a length are one document to ``index``. They are found by key and length alone; only their
    terms are brought together.
    """
    rows = docs.select(F.col(key).alias("key"), tokens(F.col("text")).alias("t"))
    sized = rows.select("key", F.size("t").alias("len"), F.array_distinct("t").alias("t"))
    # numbers only
    often = sized.groupBy("key", "len").agg(F.count("*").alias("n")).filter("n > 1").select(F.struct("key", "len").alias("of"))
    distinct = F.explode("t").alias("term")
    if often.isEmpty():
        df = sized.select(distinct).groupBy("term").agg(F.count("*").alias("df"))
    else:
        marked = sized.withColumn("own", F.struct("key", "len"))
        same = F.col("own").eqNullSafe(F.col("of"))
        alone = marked.join(often, same, "left_anti").select(distinct)
        together = marked.join(often, same, "left_semi").select("own", distinct).distinct().select("term")
        df = alone.unionByName(together).groupBy("term").agg(F.count("*").alias("df"))
    return _with_idf(df, docs.agg(F.count("*").alias("n")))


def saturation(tf: Column, length: Column, avg_len: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))


def top_k(scored: DataFrame, k: int, query: str = "qid", key: str = "doc_id") -> DataFrame:
    """The k best of each query: score falling, then key."""
    best = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)


def _add_in_order(cell: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums by cell, smallest value first: equal addends have equal sums, in whatever order they come."""
    order = np.lexsort((value, cell))
    return np.bincount(cell[order], value[order], n)


class QueryBlock:
    """Which queries of a block ask for a term."""

    def __init__(self, asked: list[tuple[int, str]]):
        self.terms = sorted({t for _, t in asked})
        number = {t: i for i, t in enumerate(self.terms)}
        self.qids = np.array(sorted({q for q, _ in asked}), np.int64)
        pairs = sorted((number[t], int(np.searchsorted(self.qids, q))) for q, t in asked)
        self.owner = np.array([q for _, q in pairs], np.int64)
        self.start = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(self.terms) + 1))


class Best:
    """The k best (score, document) of each query of a block."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.score, self.query, self.doc = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, query: np.ndarray, doc: np.ndarray) -> None:
        may = score >= self.least[query]
        score, query, doc = (np.concatenate(x) for x in zip((self.score, self.query, self.doc), (score[may], query[may], doc[may])))
        order = np.lexsort((doc, -score, query))
        score, query, doc = score[order], query[order], doc[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, int)
        nth = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        last = nth == self.k - 1
        self.least[query[last]] = score[last]
        self.score, self.query, self.doc = (x[nth < self.k] for x in (score, query, doc))


def _scores(shared, variants: list[str], k: int):
    """Maps rows (id, postings: term and its weight in each variant) to the k best documents of each query and variant in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: QueryBlock = shared.value
        number = {t: i for i, t in enumerate(block.terms)}
        best = [Best(len(block.qids), k) for _ in variants]
        for batch in batches:
            # here and not in the plan, where the condition would make another scan
            batch = batch.filter(batch.column(0).is_valid())
            ids = np.asarray(batch.column(0)).astype(np.int64)
            lists = batch.column(1)
            term, *weights = lists.flatten().flatten()
            term = np.asarray(term) if pa.types.is_integer(term.type) else np.array([number.get(t, -1) for t in term.to_pylist()], np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            asked = term >= 0
            row, term, weights = row[asked], term[asked], [np.asarray(w)[asked] for w in weights]
            asks = block.start[term + 1] - block.start[term]  # queries for each posting
            ends = np.cumsum(asks)
            at = 0
            while at < len(row):  # whole documents, of a bounded number of pairs with queries or one
                upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_PAIRS, "right"))
                if upto < len(row):
                    upto = max(int(np.searchsorted(row, row[upto])), int(np.searchsorted(row, row[at], "right")))
                some = slice(at, upto)
                n = asks[some]
                one = np.repeat(block.start[term[some]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                pair, dense = np.unique(np.repeat(row[some], n) * len(block.qids) + block.owner[one], return_inverse=True)
                doc, query = np.divmod(pair, len(block.qids))
                for found, w in zip(best, weights):
                    found.add(_add_in_order(dense, np.repeat(w[some], n), len(pair)), query, ids[doc])
                at = upto
        for name, found in zip(variants, best):
            if len(found.score):
                columns = [pa.array([name] * len(found.score)), pa.array(block.qids[found.query]), pa.array(found.doc), pa.array(found.score)]
                yield pa.RecordBatch.from_arrays(columns, names=["collection", "qid", "id", "score"])

    return run


def _counts(shared):
    """Maps rows (id, tokens) to (id, len, terms: numbers of the block's terms in the text, tfs): a row for each, copies and rows without an id too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: QueryBlock = shared.value
        terms = pa.array(block.terms, pa.string())
        for batch in batches:
            for s in range(0, batch.num_rows, STEP_ROWS):
                some = batch.slice(s, STEP_ROWS)
                lists = some.column(1)
                length = np.diff(np.asarray(lists.offsets))
                number = pc.index_in(lists.flatten(), terms)
                held = np.asarray(number.is_valid())
                cell = np.repeat(np.arange(some.num_rows), length)[held] * max(1, len(terms)) + np.asarray(number.drop_null())
                cell, tf = np.unique(cell, return_counts=True)
                row, term = np.divmod(cell, max(1, len(terms)))
                ends = pa.array(np.searchsorted(row, np.arange(some.num_rows + 1)), pa.int32())
                lists_of = lambda x: pa.ListArray.from_arrays(ends, pa.array(x, pa.int32()))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(length, pa.int32()), lists_of(term), lists_of(tf)], names=["id", "len", "terms", "tfs"])

    return run


def _weighted(batches: Iterator[pa.RecordBatch], idf: np.ndarray, mean: float, k1: float, variants: dict[str, float]) -> Iterator[pa.RecordBatch]:
    """Rows (id, postings: a term's number and its weight in each variant) of rows (id, len, terms, tfs)."""
    for batch in batches:
        for s in range(0, batch.num_rows, STEP_ROWS):
            some = batch.slice(s, STEP_ROWS)
            lists = some.column(2)
            n = np.diff(np.asarray(lists.offsets))
            term, tf = np.asarray(lists.flatten()), np.asarray(some.column(3).flatten()).astype(np.float64)
            length = np.repeat(np.asarray(some.column(1)).astype(np.float64), n)
            weights = [idf[term] * saturation(tf, length, mean, k1, b) for b in variants.values()]
            posting = pa.StructArray.from_arrays([pa.array(term, pa.int64()), *map(pa.array, weights)], names=["term", *(f"w{i}" for i in range(len(weights)))])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), posting)
            yield pa.RecordBatch.from_arrays([some.column(0), lists], names=["id", "postings"])


def search_variants(queries: DataFrame, docs: DataFrame, variants: dict[str, float], k: int = 10, k1: float = 1.2, avg_len: float | None = None, key: str = "doc_id", bands: bool = False) -> DataFrame:
    """collection, qid, key, score, rank of the k best documents of each query (qid, text), for each named b.

    Queries and documents without an id have no results; such documents count in the statistics. For each block of
    queries the corpus is tokenised once for all variants, and the counts of the terms asked for are written, a row for
    each document; statistics and scores come from these. No document is ever moved: rows alike are scored one by one.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col("qid").cast("long").alias("qid"), F.explode(query_terms(F.col("text"), bands)).alias("term")).filter("qid IS NOT NULL").distinct()
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    rows = docs.select(F.col(key).cast("long").alias("id"), tokens(F.col("text")).alias("t"))
    schema = "collection string, qid long, id long, score double"
    found = [spark.createDataFrame([], schema)]
    for b in range(blocks):
        # BLOCK_TERMS rows at most, but for chance
        pairs = [tuple(r) for r in (asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b) if blocks > 1 else asked).collect()]
        if not pairs:
            continue
        block = QueryBlock(pairs)
        shared = spark.sparkContext.broadcast(block)
        held = work.written(rows.mapInArrow(_counts(shared), "id long, len int, terms array<int>, tfs array<int>"), "counts")
        n, total = held.agg(F.count("*"), F.sum(F.col("len").cast("long"))).first()
        df = np.zeros(len(block.terms))
        for r in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():  # of the block's terms
            df[r["term"]] = r["n"]
        inverse = np.log(1 + (n - df + 0.5) / (df + 0.5))
        mean = float(avg_len if avg_len is not None else (total or 0) / n if n else 0.0)

        def score(batches: Iterator[pa.RecordBatch], shared=shared, inverse=inverse, mean=mean) -> Iterator[pa.RecordBatch]:
            return _scores(shared, list(variants), k)(_weighted(batches, inverse, mean, k1, variants))

        found.append(held.mapInArrow(score, schema))
    best = Window.partitionBy("collection", "qid").orderBy(F.desc("score"), "id")
    out = reduce(DataFrame.unionByName, found[1:] or found)
    return out.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k).select("collection", "qid", F.col("id").alias(key), "score", "rank")


def search(queries: DataFrame, docs: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, avg_len: float | None = None, key: str = "doc_id", bands: bool = False) -> DataFrame:
    """qid, key, score, rank of the k best documents of each query (qid, text)."""
    return search_variants(queries, docs, {"": b}, k, k1, avg_len, key, bands).drop("collection")


def token_overlap(a: Column, b: Column) -> dict[str, Column]:
    """Shared terms and those of one side only, sorted, and whether both have the same set."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    joined = lambda c: F.array_join(F.array_sort(c), " ")
    only_a, only_b = F.array_except(x, y), F.array_except(y, x)
    return {"shared": joined(F.array_intersect(x, y)), "only_a": joined(only_a), "only_b": joined(only_b), "same": (F.size(only_a) == 0) & (F.size(only_b) == 0)}
