"""Reciprocal rank fusion of ranked lists, and the plan choice between hybrid and dense search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dense, lexical


def rrf(runs: list[DataFrame], limit: int, rrf_k: int = 60, key: str = "doc_id") -> DataFrame:
    """qid, key, score, rank: sums of 1 / (k + rank); a list without the item adds nothing."""
    both = reduce(DataFrame.unionByName, [r.select("qid", F.col(key).cast("long").alias(key), "rank") for r in runs])
    # a list for each run at most; summed in order of size, so that equal ranks in other lists tie
    ranks = F.array_sort(F.collect_list("rank"))
    total = F.aggregate(ranks, F.lit(0.0), lambda t, r: t + 1 / (rrf_k + r))
    scored = both.groupBy("qid", key).agg(total.alias("score"))
    return lexical.top_k(scored, limit, key=key).select("qid", key, "score", "rank")


def hybrid(text_queries: DataFrame | None, vector_queries: DataFrame, docs: DataFrame, vectors: DataFrame, limit: int, prefetch: int = 40, rrf_k: int = 60, is_hybrid: bool = True) -> DataFrame:
    """Both sides fused where the collection is hybrid and there are text queries; else dense alone."""
    if not is_hybrid or text_queries is None:
        return dense.top_k(vector_queries, vectors, limit).withColumnRenamed("vec_id", "doc_id")
    near = dense.top_k(vector_queries, vectors, prefetch).withColumnRenamed("vec_id", "doc_id")
    return rrf([near, lexical.search(text_queries, docs, prefetch)], limit, rrf_k)
