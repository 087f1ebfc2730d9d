"""Cutting a plan's lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
#: Tables in the shared folder that this process has made and not yet deleted.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a folder of our own if all of Spark runs in this process,
    as in tests; on a cluster that is an error, since executors don't see each other's disks."""
    global _own_dir
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="spark-coreloom-", dir="/tmp")
    return _own_dir


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Of what is executed inside, shuffle files go as soon as it has ended, not when the driver happens to collect its
    garbage: of many steps one after the other, the disk holds those of one."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def written(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """df written as a table to path and read from there."""
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df written as a table to the shared folder and read from there: what follows starts anew, and a lost executor
    costs only the work done since."""
    return written(df, owned(f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"), compression)


def owned(path: str) -> str:
    """path, which `release` will delete."""
    _made.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes the tables that operators have left in the shared folder, and gives their number. Results that operators gave
    before read them, so whoever calls this has written or collected those; a job does after each of its steps."""
    n = len(_made)
    while _made:
        p = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return n
