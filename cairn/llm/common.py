"""What the operators share: reading tables, the shared work folder, block counts."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
"""Translation table that lower-cases A-Z in UTF-8 bytes and nothing else."""


TASK_BYTES = 8 << 20
LEAST_TASKS = 24
ROWS_PER_FILE = 100_000


def tasks_for(df: DataFrame) -> int:
    """As many tasks as the bytes of a table need; many where they are not known."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(LEAST_TASKS, -(-size // TASK_BYTES)), 1 << 20)


def few_files(df: DataFrame) -> DataFrame:
    """A table in very many tiny files is read by as many tasks as its bytes need; others stay as they are."""
    return df.coalesce(tasks_for(df))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return few_files(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def files_for(rows: int) -> int:
    """Files for a small intermediate table of so many rows."""
    return max(4, -(-rows // ROWS_PER_FILE))


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset and all runs in one JVM a new one."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back; cuts lineage, survives lost executors.

    ``files`` bounds the number of files of a table that is known to be small beside the number of partitions.

    The files go when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(remove, spark, path)


def remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if getattr(sc, "_jsc", None) is None:
        return
    try:
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone at exit
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of text in all rows; one pass without a shuffle of texts."""
    return docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def with_copies(df: DataFrame, copies: str, step: int = 1 << 16) -> DataFrame:
    """Each row as often as ``copies`` says; no array on the way is longer than ``step``."""
    df = df.filter(F.col(copies) > 0).withColumn("part_of_copies", F.explode(F.sequence(F.lit(0), F.floor((F.col(copies) - 1) / step).cast("int"))))
    own = F.least(F.lit(step), F.col(copies) - F.col("part_of_copies") * F.lit(step).cast("long"))
    return df.withColumn(copies, F.explode(F.array_repeat(F.lit(0), own.cast("int")))).drop(copies, "part_of_copies")


def give_back() -> None:
    """Returns freed memory of a Python worker to the system; workers live on after a task."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
