"""Spark session settings for the library's jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # keys and counts take many times their shuffled size in a task's hash table
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    # staged change batches are checkpointed; drop the files once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app_name: str = "innkeep", conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's settings.

    On a cluster, leave ``master`` unset and let spark-submit decide; tests
    and the benchmark pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **(conf or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bound_tasks(spark: SparkSession) -> None:
    """Bound what a task reads of a shuffle, unless the session names a size itself."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, DEFAULTS[size])


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder for lineage cuts, from ``spark.checkpoint.dir``.

    ``fallback`` is used only when the session names none (tests, local runs).
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if fallback is None:
        raise RuntimeError("spark.checkpoint.dir is not set; pass a shared folder")
    os.makedirs(fallback, exist_ok=True) if "://" not in fallback else None
    spark.sparkContext.setCheckpointDir(fallback)
    return spark.sparkContext.getCheckpointDir() or fallback


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and tables between jobs.

    It is the one the session names; a local session that names none gets a
    temporary folder, any other raises: its executors could not read one.
    """
    local = spark.sparkContext.master.startswith("local")
    folder = checkpoint_dir(spark, tempfile.mkdtemp(prefix="innkeep-") if local and not has_checkpoint_dir(spark) else None)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below :func:`scratch_dir`."""
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once when several branches of a plan read it.

    With a shared checkpoint folder (``spark.checkpoint.dir`` or
    ``SparkContext.setCheckpointDir``) the rows are written there by a
    reliable ``checkpoint()``: the branches read them back instead of
    recomputing the lineage, and a lost executor costs a re-read, not a
    recomputation.  Without one the plan stays lazy (Spark recomputes).
    """
    if has_checkpoint_dir(df.sparkSession):
        return df.checkpoint(eager=True)
    return df


def has_checkpoint_dir(spark: SparkSession) -> bool:
    """Whether the session names a checkpoint folder (classic or Spark Connect)."""
    try:
        return bool(spark.sparkContext.getCheckpointDir())
    except Exception:  # Spark Connect: no SparkContext on the client
        return bool(spark.conf.get("spark.checkpoint.dir", None))
