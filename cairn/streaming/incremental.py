"""Keeps an index up to date as documents arrive: each micro-batch appends its postings, or replaces those of older versions.

A batch is written under its number, so one that is repeated after a failure replaces
itself. df and N come from the postings at query time and so stay right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lexical import postings, term_idf
from ..sources.store import Store


def append_postings(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        postings(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_idf(spark, path: str) -> DataFrame:
    index = spark.read.parquet(path)
    stats = index.groupBy("doc_id").agg(F.max("len").alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    return term_idf(index, stats)


def keep_latest(docs: DataFrame, store: Store, checkpoint: str, key: str = "doc_id", version: str = "version", name: str = "documents") -> StreamingQuery:
    """Each document's last version ends in a stored index: a replaced text takes its old postings back.

    A batch is one new snapshot that also records its number, so one that is repeated after a failure changes
    nothing; versions may come late and in any order.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.recover()
        store.upsert(batch, key, version, (name, number))

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
