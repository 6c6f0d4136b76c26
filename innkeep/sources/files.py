"""Folders on the file system that Spark reads (local, HDFS or an object store)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _handle(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, path: str) -> list[str]:
    """Names under a folder, ascending; none if it isn't there."""
    fs, p = _handle(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder was committed."""
    fs, p = _handle(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it."""
    fs, p = _handle(spark, path)
    fs.delete(p, True)
