"""Shared working folder for written intermediate tables and checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}
_made: list[str] = []
#: Whether Spark deletes the shuffle files of a query when it ends, not when the driver collects its memory.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tasks that list folders, if there are many.
_LISTINGS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def shared_root(spark: SparkSession) -> str:
    """This application's working folder, on a file system that every executor reaches.

    It lies in the folder named by ``spark.checkpoint.dir``, else in the warehouse folder, and goes
    when the application ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    root = f"{base.rstrip('/')}/stratapanel-{spark.sparkContext.applicationId}"
    if root not in _folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _folders[root] = fs.makeQualified(path).toString()
    return _folders[root]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the working folder, never used before."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def made() -> list[str]:
    """The working tables that there are, oldest first."""
    return list(_made)


def drop_unread(spark: SparkSession, paths: list[str], needed: DataFrame) -> list[str]:
    """Delete those of some working tables that a result does not read; returns the others.

    For jobs in stages: when a stage begins, what came before is written and only its input counts.
    """
    files = needed.inputFiles()
    read = [p for p in paths if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in files)]
    for path in set(paths) - set(read):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        _made.remove(path)
    return read


def cut_lineage(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a table to the working folder and read it back.

    Iterative and many-branched plans restart from the files after an executor is lost, and
    every branch sees the same rows. ``codec`` compresses the files in another way than Spark's default.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Tables written in this context leave no shuffle files behind.

    For one thread, and for steps that write each table once. A result for the caller to read is made after it.
    """
    with _set(spark, _CLEANUP, "true"):
        yield


@contextmanager
def few_listings(spark: SparkSession) -> Iterator[None]:
    """Tables opened in this context list their folders by a few tasks for each core, not by a task for each folder."""
    with _set(spark, _LISTINGS, str(4 * spark.sparkContext.defaultParallelism)):
        yield


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
