"""Reading and writing corpora, questions, answers and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from . import work

SPLIT_ON = "_high_enrage_"


TASK_BYTES = 512 << 10


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a scan has too few tasks for its bytes: a file with one row group can't be split.

    A scan that has a task for each core, as every large input does, stays as it is, and so do tiny tables.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES)
    return df.repartition(wanted) if wanted > 1 and df.rdd.getNumPartitions() < wanted else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def scan_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """source (file name) and text of the *.txt files directly in a folder."""
    found = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))
    return found.orderBy("source")


def load_documents(spark: SparkSession, folder: str) -> DataFrame:
    """As scan_corpus, but no file at all is an error."""
    found = scan_corpus(spark, folder)
    if found.isEmpty():
        raise FileNotFoundError(f"no .txt files in {folder}")
    return found


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions; an expected source may be null, a string or a list in the file, and is a list or null here."""
    fields = schema.QUESTION.replace("expected_source array<string>", "expected_source string").replace(" array<string>", ": array<string>").replace(" string", ": string").replace("::", ":")
    raw = spark.read.schema(f"questions array<struct<{fields}>>").json(path, multiLine=True).select(F.inline("questions"))
    src = F.col("expected_source")
    listed = F.when(src.startswith("["), F.from_json(src, "array<string>")).otherwise(F.array(src))
    return raw.withColumn("expected_source", F.when(F.coalesce(src, F.lit("")).isin("", "[]"), None).otherwise(listed))


def write_json(df: DataFrame, path: str) -> None:
    """Replaces what is there."""
    df.write.mode("overwrite").json(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.ANSWER).json(path)


def stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def style_of(name: Column) -> Column:
    s = stem(name)
    return F.when(s.contains(SPLIT_ON), F.split(s, SPLIT_ON, 2)[1]).otherwise(s)


def boss_of(name: Column) -> Column:
    s = stem(name)
    return F.when(s.contains(SPLIT_ON), F.split(s, SPLIT_ON, 2)[0]).otherwise(s)


def text_of(payload_text: Column, page_content: Column) -> Column:
    return F.coalesce(F.nullif(payload_text, F.lit("")), page_content, F.lit(""))


def section_of(h1: Column, h2: Column, h3: Column) -> Column:
    """The deepest header."""
    return F.coalesce(h3, h2, h1, F.lit(""))


def shown_section(h2: Column, h3: Column) -> Column:
    """What a response names: the third header, else the second, never the first."""
    return F.coalesce(F.nullif(h3, F.lit("")), h2)


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """0-based positions in the order of these columns, nulls first; keys of any type, spread in any way.

    Rows are dealt into sampled ranges and written in order, each with its place in its range; the counts of the
    ranges before are added. No window, and no task that sees more than a range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a task's ids are its number, 33 bits further left, and the place of the row
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = work.written(placed, "numbered")
    counts = {r["r"]: r["n"] for r in placed.groupBy(F.shiftright("_at", 33).alias("r")).agg(F.count("*").alias("n")).collect()}  # a number for each range
    before, total = [], 0
    for r in sorted(counts):
        before.append((r, total))
        total += counts[r]
    offsets = F.broadcast(spark.createDataFrame(before, "_range long, _before long"))  # one row for each range
    out = placed.join(offsets, F.shiftright("_at", 33) == F.col("_range"))
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_range", "_before")


def write_index(chunks: DataFrame, path: str, hybrid: bool) -> None:
    """A hybrid index replaces what is there; a dense-only one appends."""
    chunks.write.mode("overwrite" if hybrid else "append").parquet(path)


def index_exists(spark: SparkSession, path: str) -> bool:
    files, target = work.file_system(spark, path)
    return files.exists(target)


def delete_index(spark: SparkSession, path: str) -> bool:
    """True if there was one."""
    files, target = work.file_system(spark, path)
    return files.delete(target, True)
