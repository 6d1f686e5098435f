"""Tables written on the way: in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset and all runs in one JVM a new folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    if getattr(spark.sparkContext, "_jsc", None) is None:
        return
    try:
        files, target = file_system(spark, path)
        files.delete(target, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone at exit
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the Python process ends."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once and read back: lineage ends here, and lost executors lose nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, or None if there is none."""
    files, target = file_system(spark, path)
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file; one that is there already is an error."""
    files, target = file_system(spark, path)
    stream = files.create(target, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def swap(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file onto another in one step: readers see the old one or the new one."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs
    over = getattr(fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(over, 1)
    options[0] = over.OVERWRITE
    a, b = fs.Path(source), fs.Path(target)
    # an unqualified path belongs to the default file system
    context = fs.FileContext.getFileContext(file_system(spark, target)[0].getUri(), spark._jsc.hadoopConfiguration())
    context.rename(a, b, options)
