"""What a model says to texts, kept by content: a text is asked once, and a run that broke off goes on where it was.

Texts are told apart by their SHA-256. Finished ones are taken from the store and never asked
again, whoever asks; what is open is dealt into parts by hash, and each part is appended to
the store when it is done, so a killed run loses the part that it was in. A part's texts go
to the model in batches of bounded bytes. A batch that fails is asked again text by text; a
text that fails is a row of its own with the error, and is open again in the next run until
as many runs as ``tries`` have failed.

Defined cases: a null text has a null result and is not asked; repeated texts are asked once
and all get the result; a model that gives another number of results than texts, or None for
one, has failed there; no texts leave the store as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import work

BATCH_BYTES = 64 << 10
PART_BYTES = 256 << 20
SCHEMA = "content string, result string, error string"

#: Gives a result for each text of a batch.
Model = Callable[[list[str]], list[str]]


def batches_of(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Texts in order, ``limit`` bytes at a time, or a longer one alone."""
    batch: list[str] = []
    size = 0
    for text in texts:
        n = len(text.encode())
        if batch and size + n > limit:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += n
    if batch:
        yield batch


def ask(model: Model, texts: list[str]) -> list[tuple[str | None, str | None]]:
    """(result, error) of each text of a batch; where the batch fails, of each text alone."""
    try:
        found = model(texts)
        if len(found) != len(texts) or any(x is None for x in found):
            raise ValueError(f"{len(found)} results for {len(texts)} texts, or none for one")
        return [(x, None) for x in found]
    except Exception as e:  # noqa: BLE001 - a model may fail in any way
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}"[:500])]
        return [ask(model, [t])[0] for t in texts]


def stored(spark: SparkSession, path: str) -> DataFrame:
    """content, result, error, failures: the result where there is one, else the last error."""
    files, target = work.file_system(spark, path)
    rows = spark.read.schema(SCHEMA).parquet(path) if files.exists(target) else spark.createDataFrame([], SCHEMA)
    last = rows.groupBy("content").agg(F.max("result").alias("result"), F.max("error").alias("error"), F.count("error").alias("failures"))
    return last.withColumn("error", F.when(F.col("result").isNull(), F.col("error")))


def run(texts: DataFrame, model: Model, path: str, text: str = "text", tries: int = 3, parts: int | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The rows of ``texts`` with result and error; what is open is asked first, and kept at ``path``."""
    spark = texts.sparkSession
    hashed = texts.withColumn("content", F.sha2(text, 256))
    closed = stored(spark, path).filter(F.col("result").isNotNull() | (F.col("failures") >= tries)).select("content")
    each = hashed.filter(F.col(text).isNotNull()).groupBy("content").agg(F.first(text).alias("asked"))
    open_ = work.written(each.join(closed, "content", "left_anti"), "open")
    n, size = open_.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("asked")), F.lit(0))).first()
    parts = parts or max(1, -(-size // PART_BYTES))

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, own, at = b.column(0).to_pylist(), b.column(1).to_pylist(), 0
            for some in batches_of(own, batch_bytes):
                found = ask(model, some)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + len(some)]), *(pa.array([x[i] for x in found], pa.string()) for i in (0, 1))], names=["content", "result", "error"])
                at += len(some)

    for part in range(parts if n else 0):
        own = open_.filter(F.pmod(F.xxhash64("content"), F.lit(parts)) == part)
        own.mapInArrow(call, SCHEMA).write.mode("append").parquet(path)
    answers = stored(spark, path).select("content", "result", "error")
    return hashed.join(answers, "content", "left").drop("content")
