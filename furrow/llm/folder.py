"""Tables that cut lineage, kept where the driver and all executors can read them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Where the tables of bucketed lie.
_places: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; on a local master without one, as in tests, a new temporary folder."""
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


def _path(spark: SparkSession, path: str):
    """Hadoop's file system and path, for a path that Spark can read."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession, name: str) -> str:
    """An empty folder of its own in the shared folder. The driver's end deletes it."""
    path = f"{shared_folder(spark)}/furrow-{name}-{uuid.uuid4().hex}"
    files, at = _path(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session while this lasts."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: its lineage ends there, so its shuffles' files go at once. The driver's end deletes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/furrow-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    files, at = _path(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str, then: Callable[[DataFrame], DataFrame] = lambda d: d) -> tuple[DataFrame, str]:
    """df as a table bucketed by column, in as many buckets as shuffles have, and its name in the catalog, which is to be forgotten after use.

    Joins and sums by column leave it where it is; then is such work, done between the deal and the table. Its files lie in the shared folder.
    """
    spark = df.sparkSession
    path, name = f"{shared_folder(spark)}/furrow-{name}-{uuid.uuid4().hex}", f"furrow_{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    then(df.repartition(n, column)).write.bucketBy(n, column).option("path", path).saveAsTable(name)
    files, at = _path(spark, path)
    files.deleteOnExit(at)
    _places[name] = path
    return spark.table(name), name


def forgotten(spark: SparkSession, name: str) -> None:
    """Drops a table of bucketed with its files."""
    spark.sql(f"drop table {name}")
    files, at = _path(spark, _places.pop(name))
    files.delete(at, True)


@contextmanager
def single_rows(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python one at a time while this lasts: for rows of some MB, so that a batch is one of them."""
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1"):
        yield


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
