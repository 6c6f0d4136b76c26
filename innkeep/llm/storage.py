"""Shared-folder helpers: every lineage cut goes where all executors can read it."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset (tests), an own folder.

    The context's checkpoint folder is set from it when the session has none.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(folder)
        return folder
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="innkeep-checkpoint-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one run's files below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once by a reliable checkpoint and read it back."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`new_path` named."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to a new Parquet folder and read it back with its schema."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, path: str) -> DataFrame:
    """:func:`written`, whose shuffle files go as soon as it has ended (else they stay until the driver collects garbage)."""
    conf = df.sparkSession.conf
    before = conf.get(FILE_CLEANUP, None)
    conf.set(FILE_CLEANUP, "true")
    try:
        return written(df, path)
    finally:
        conf.set(FILE_CLEANUP, before) if before is not None else conf.unset(FILE_CLEANUP)


BROADCAST_ROWS = 500_000  # lists up to here are broadcast (about 32 MB); longer ones are joined by a shuffle


def checked(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Rows and bytes of an Arrow batch: the JVM, the socket and the worker hold some copies of one per running task.
ARROW_ROWS = 1000
ARROW_BYTES = 4 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small, and give the executors this package's Python files (once per application)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="innkeep-files-")) / "innkeep_files.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
