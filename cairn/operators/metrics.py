"""Ranking metrics over runs (collection, qid, doc_id, score, rank) and labels (collection, qid, doc_id)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)
K = 10
SIGNIFICANT = 0.05


def reciprocal_rank(run: DataFrame, labels: DataFrame, k: int = K, by: tuple[str, ...] = ("qid",), key: str = "doc_id") -> DataFrame:
    """first_rank (null if none in k) and rr of each question that has a label."""
    asked = labels.select(*by).distinct()
    hits = run.filter(F.col("rank") <= k).join(labels.select(*by, key), [*by, key], "left_semi")
    first = hits.groupBy(*by).agg(F.min("rank").alias("first_rank"))
    return asked.join(first, list(by), "left").withColumn("rr", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)))


def hit_rates(ranks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """hit_rate@k, mrr@10 and the number of questions."""
    hit = lambda k: F.avg(F.coalesce((F.col("first_rank") <= k).cast("int"), F.lit(0)).cast("double"))
    return ranks.groupBy(*by).agg(*(hit(k).alias(f"hit_rate@{k}") for k in KS), F.avg("rr").alias("mrr@10"), F.count("*").alias("questions"))


def mrr_by_tag(tags: DataFrame, ranks: DataFrame, collections: list[str], least: int = 4) -> DataFrame:
    """Mean rr by tag, a column a collection; members are what the first collection scored, others' missing ones are 0."""
    own = lambda c: F.max(F.when(F.col("collection") == c, F.col("rr")))
    wide = ranks.groupBy("qid").agg(*(own(c).alias(c) for c in collections)).filter(F.col(collections[0]).isNotNull())
    return tags.join(wide, "qid").groupBy("tag").agg(F.count("*").alias("n"), *(F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in collections)).filter(F.col("n") >= least)


def paired_t(ranks: DataFrame, baseline: str) -> DataFrame:
    """collection, n, mean_diff, t, p, verdict against the baseline, over the questions that all collections scored."""
    # a question's scores side by side: as many as there are collections
    wide = ranks.groupBy("qid").agg(F.collect_list(F.struct("collection", "rr")).alias("own"))
    shared = wide.join(F.broadcast(ranks.agg(F.countDistinct("collection").alias("all"))), F.size("own") == F.col("all"), "left_semi")
    base = F.element_at(F.filter("own", lambda x: x["collection"] == baseline), 1)["rr"]
    d = shared.select(F.inline(F.transform(F.filter("own", lambda x: x["collection"] != baseline), lambda x: F.struct(x["collection"].alias("collection"), (x["rr"] - base).alias("d")))))
    sd = F.stddev_samp("d")
    out = d.groupBy("collection").agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), F.try_divide(F.avg("d"), sd / F.sqrt(F.count("*"))).alias("t"))
    # a row for each collection
    p = F.pandas_udf(lambda t, n: pd.Series([None if t_ is None or t_ != t_ else p_value(t_, n_ - 1) for t_, n_ in zip(t, n)], dtype="float64"), "double")
    out = out.withColumn("p", p("t", "n"))
    return out.withColumn("verdict", F.when(F.col("p") < SIGNIFICANT, "significant").when(F.col("p").isNotNull(), "not significant"))


def p_value(t: float, freedom: int) -> float:
    """Two-sided, from the regularised incomplete beta function by its continued fraction."""
    x = freedom / (freedom + t * t)
    a, b = freedom / 2, 0.5

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
        h = d
        for m in range(1, 400):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + top * d) or tiny)
                c = (1 + top / c) or tiny
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return h

    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def verdict(p: float) -> str:
    return "significant" if p < SIGNIFICANT else "not significant"


def first_ranks(questions: DataFrame, run: DataFrame, labels: DataFrame, k: int = K, key: str = "doc_id") -> DataFrame:
    """qid, rank of the first relevant hit (or null), score of the top hit (0 without hits)."""
    top = run.filter(F.col("rank") <= k).groupBy("qid").agg(F.max("score").alias("top"))
    first = reciprocal_rank(run, labels, k, key=key).select("qid", "first_rank")
    return questions.select("qid").join(first, "qid", "left").join(top, "qid", "left").select("qid", "first_rank", F.coalesce("top", F.lit(0.0)).alias("top_score"))


def compare_ranks(a: DataFrame, b: DataFrame, k: int = K) -> DataFrame:
    """Questions' ranks in two runs; one that isn't found ranks k + 1 for the comparison."""
    both = a.select("qid", F.col("first_rank").alias("rank_a"), F.col("top_score").alias("top_a")).join(b.select("qid", F.col("first_rank").alias("rank_b"), F.col("top_score").alias("top_b")), "qid")
    x, y = (F.coalesce(c, F.lit(k + 1)) for c in ("rank_a", "rank_b"))
    return both.withColumn("change", F.when(y < x, "better").when(y > x, "worse").otherwise("tie"))


def rank_changes(compared: DataFrame) -> DataFrame:
    """How many questions rank differently in the two runs, better and worse in the second."""
    differ = F.coalesce("rank_a", F.lit(0)) != F.coalesce("rank_b", F.lit(0))
    # not found at all and found at k + 1 differ, though neither is better
    return compared.agg(F.count(F.when(differ, 1)).alias("differing"), *(F.count(F.when(F.col("change") == c, 1)).alias(c) for c in ("better", "worse")))
