"""A corpus pipeline of five of the operators; each stage works on all that the one before kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep
the columns of documents (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import mixing, packing, repeats, simhash, toxicity
from cairn.llm.common import few_files, read, remove, remove_at_exit, work_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a toxic verdict; each is judged by its own text, with an id or without."""
    scored = toxicity.score(few_files(docs), read(spark, sf_dir, "labels"), carry=COLUMNS[1:])
    return scored.filter("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id; rows without an id come last."""
    return simhash.one_of_each(few_files(docs), COLUMNS[1:]).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier document holds; a character that lost a byte goes."""
    kept = repeats.remove_repeats(docs, keep_text=True, carry=("lang", "source")).withColumnRenamed("kept", "text")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; those without words are not in it."""
    return mixing.mix_rows(few_files(docs)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(few_files(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fingerprints, random rounding and token ids have no SQL form; run() is tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's files go when the next stage is written, the last ones at exit."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
