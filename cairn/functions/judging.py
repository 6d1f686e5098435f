"""Rules on answers and on a judge's replies. The judge itself is data: its replies are columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import REFUSALS

MOST_CLAIMS = 8
LEAST_CHARS = 15
#: Where claims end, and what is trimmed around them.
CLAIM_END = r"""(?<=[.!?])["')\]]*\s+|\n+"""
_TRIM = " -•\"'"
TRIES = 2


def split_claims(answer: Column) -> Column:
    parts = F.split(answer, CLAIM_END, -1)
    trimmed = F.transform(parts, lambda p: F.btrim(p, F.lit(_TRIM)))
    return F.slice(F.filter(trimmed, lambda p: F.length(p) > LEAST_CHARS), 1, MOST_CLAIMS)


def refusal_phrase(answer: Column) -> Column:
    return F.lower(answer).rlike("|".join(REFUSALS))


def refused(answer: Column, verdict: Column) -> Column:
    """True by a phrase; else what the judge said."""
    return F.when(refusal_phrase(answer), F.lit(True)).otherwise(verdict)


def yes_no(reply: Column) -> Column:
    """True for a yes, else False for a no, else null."""
    return F.when(F.lower(reply).rlike(r"\byes\b"), True).when(F.lower(reply).rlike(r"\bno\b"), False)


def first_yes_no(replies: Column) -> Column:
    """The first readable one of an array of replies."""
    read = F.filter(F.transform(replies, yes_no), lambda x: x.isNotNull())
    return F.get(read, 0)


def relevancy(reply: Column) -> Column:
    """The first number of the reply over 10, at most 1."""
    number = F.regexp_extract(reply, r"\d+(?:\.\d+)?", 0)
    return F.when(number != "", F.least(number.try_cast("double") / 10, F.lit(1.0)))


def first_relevancy(replies: Column) -> Column:
    """The first readable rating of an array of replies."""
    return F.get(F.filter(F.transform(replies, relevancy), lambda x: x.isNotNull()), 0)


def attempts(replies: Column, read) -> tuple[Column, Column]:
    """How many of at most TRIES replies were unreadable before one was not, and whether none was readable; ``read`` gives null for the unreadable."""
    tried = F.transform(F.slice(replies, 1, TRIES), lambda r: read(r).isNotNull())
    first = F.array_position(tried, True)
    return F.when(first > 0, first - 1).otherwise(F.size(tried)).cast("long"), first == 0


def timing(answers: DataFrame) -> DataFrame:
    """Number of answers, their minutes in all and seconds each."""
    return answers.agg(F.count("*").alias("answers"), (F.sum("seconds") / 60).alias("minutes"), F.avg("seconds").alias("seconds_each"))


def faithfulness(verdicts: DataFrame, key: str = "id") -> DataFrame:
    """Share of readable verdicts that support; null if none is readable."""
    return verdicts.groupBy(key).agg(F.avg(F.col("verdict").cast("int").cast("double")).alias("faithfulness"))


def score_record(answers: DataFrame) -> DataFrame:
    """Routes id, answerable, answer, verdict, faithfulness, relevancy to a score record."""
    empty = F.regexp_replace("answer", r"\s+", "") == ""
    out = answers.withColumn("empty", empty).withColumn("refused", F.when(~F.col("empty"), refused(F.col("answer"), F.col("verdict"))))
    tried = ~F.col("empty") & F.col("answerable") & ~F.coalesce(F.col("refused"), F.lit(False))
    return out.select("id", "answerable", "empty", "refused", F.when(tried, F.col("faithfulness")).alias("faithfulness"), F.when(tried, F.col("relevancy")).alias("relevancy"))


def summarise(scores: DataFrame, parse_failures: Column | None = None) -> DataFrame:
    """The headline means; null scores are left out of each."""
    rate = lambda cond: F.avg(F.when(cond & F.col("refused").isNotNull(), F.col("refused").cast("int").cast("double")))
    calls = F.sum(F.when(F.col("answerable"), 2 + MOST_CLAIMS).otherwise(1))
    failures = F.lit(0) if parse_failures is None else F.coalesce(F.sum(parse_failures), F.lit(0))
    return scores.agg(
        F.avg(F.when(F.col("answerable"), F.col("faithfulness"))).alias("faithfulness"),
        F.avg(F.when(F.col("answerable"), F.col("relevancy"))).alias("relevancy"),
        rate(~F.col("answerable")).alias("refusal_rate"),
        rate(F.col("answerable")).alias("false_refusal_rate"),
        F.avg(F.col("empty").cast("int").cast("double")).alias("empty_answer_rate"),
        F.coalesce(F.try_divide(failures.cast("double"), calls), F.lit(0.0)).alias("judge_parse_failure_rate"),
    )


def unreliable(rate: float) -> bool:
    """True where so many replies were unreadable that the means say little."""
    return rate > 0.05
