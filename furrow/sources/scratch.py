"""Tables that are made once and read several times, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder that the context was given; only a local master may fall back on a new temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="furrow-"))
    return _own[0]


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in its terms."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession, name: str) -> str:
    """An empty folder of its own in the shared folder. The driver's end deletes it."""
    path = f"{shared_folder(spark)}/furrow-{name}-{uuid.uuid4().hex}"
    files, at = file_system(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: it is made once, and a lost executor costs no more than the read. The driver's end deletes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/furrow-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    files, at = file_system(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(schema).parquet(path)
