"""Context and prompt of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import strip_tokens
from ..functions.lookup import STYLE_LABELS

PROMPT = "Answer the question from the context alone.\n\nContext:\n{context}\n\nQuestion:\n{question}\n"


def style_label(style: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in STYLE_LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, style), F.nullif(style, F.lit("")), F.lit("guide"))


def format_context(hits: DataFrame) -> DataFrame:
    """qid and context from (qid, rank, style, text): labelled chunks in order of rank. A query has its k hits only."""
    part = F.concat(F.lit("[From the "), style_label(F.col("style")), F.lit(" guide]\n"), strip_tokens(F.col("text")))
    listed = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return hits.groupBy("qid").agg(F.array_join(F.transform(listed, lambda x: x["part"]), "\n\n").alias("context"))


def prompt(context: Column, question: Column, template: str = PROMPT) -> Column:
    before, rest = template.split("{context}")
    middle, after = rest.split("{question}")
    return F.concat(F.lit(before), context, F.lit(middle), question, F.lit(after))
