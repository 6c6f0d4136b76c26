"""Stored tables that a batch of changes rewrites in part (I1 on files).

A table is stored in one folder per range of its key (or per day, per hash
bucket of a text key).  :func:`merge` reads and writes only the folders that the
batch touches, by Parquet partition pruning and dynamic partition overwrite;
all other files stay as they are.  The result equals
:func:`innkeep.operators.changes.upsert` of the whole table.

* Ranges: ids are given out in ascending order, so new rows land in the last
  ranges.  ``width`` is the least number of ids in a folder.  :func:`store`
  doubles it until the table has at most ``FOLDERS`` folders or one holds
  ``FOLDER_IDS`` ids, and the path names the doubling, where later merges find it:
  time goes into rows, not into ever more folders of ``width`` rows.
* A column of its own, such as a date: an upsert may move a row to another
  folder, so the folders that hold the batch's keys are looked up first (only
  key and folder are read).
* Text keys: hash buckets; their number is part of the path, so a table can't be
  merged with another number by mistake.

Rows of a folder meet in few tasks before they are written, so the number of
files follows the folders, not folders times tasks.

The merged rows are checkpointed before any folder is overwritten: a task that
is run again reads them, not the folders being replaced, and a merge that was
cut short is completed by merging the same batch again.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import scratch_dir
from . import files

PART = "__part"
FOLDERS = 1024  # a stored table has at most so many ranges,
FOLDER_IDS = 2**20  # unless they hold so many ids


@dataclass(frozen=True)
class Layout:
    """How a table with primary key ``key`` is cut: one of ``width``, ``column`` and ``buckets``."""

    key: str
    width: int = 0
    column: str = ""
    buckets: int = 0
    times: int = 1  # a folder has times * width ids; set by store()

    def __post_init__(self):
        if sum(map(bool, (self.width, self.column, self.buckets))) != 1:
            raise ValueError("a layout has one of width, column and buckets")

    def part(self) -> Column:
        """The folder of a row, as text."""
        if self.width:
            part = F.floor(F.col(self.key) / (self.width * self.times)).cast("bigint")
        elif self.buckets:
            part = F.pmod(F.xxhash64(self.key), F.lit(self.buckets))
        else:
            part = F.col(self.column)
        return F.coalesce(part.cast("string"), F.lit("null"))

    def folder(self, path: str) -> str:
        kind = f"width={self.width}" + (f"x{self.times}" if self.times > 1 else "") if self.width else f"buckets={self.buckets}" if self.buckets else f"by={self.column}"
        return f"{path.rstrip('/')}/{kind}"


def _fitted(table: DataFrame, layout: Layout) -> Layout:
    """Ranges wide enough for the table's ids."""
    if not layout.width:
        return layout
    least, top = table.agg(F.min(layout.key), F.max(layout.key)).first()
    times = 1
    while least is not None and (top - least) // (layout.width * times) >= FOLDERS and layout.width * times < FOLDER_IDS:
        times *= 2
    return replace(layout, times=times)


def _found(spark: SparkSession, path: str, layout: Layout) -> Layout | None:
    """The layout as stored, None where the table isn't."""
    for name in files.names(spark, path):
        kind, _, times = name.partition("x") if layout.width else (name, "", "")
        found = replace(layout, times=int(times or 1))
        if found.folder(path).endswith(f"/{name}"):
            return found
    return None


def _dealt(rows: DataFrame, layout: Layout) -> DataFrame:
    """Rows of a folder meet, so that it holds few files."""
    # the key too, but for ranges of bounded size: a folder with a third of all rows is written by many tasks
    return rows.repartition(PART, *([] if layout.width else [F.pmod(F.xxhash64(layout.key), F.lit(8))]))


def store(table: DataFrame, path: str, layout: Layout, mode: str = "errorifexists") -> None:
    """Write a table in its layout; rows of a folder meet first, so that it holds few files."""
    spark = table.sparkSession
    old = _found(spark, path, layout)
    layout = _fitted(table, layout) if old is None or mode == "overwrite" else old
    _dealt(table.withColumn(PART, layout.part()), layout).write.mode(mode).partitionBy(PART).parquet(layout.folder(path))
    if old not in (None, layout):
        files.remove(spark, old.folder(path))


def load(spark: SparkSession, path: str, layout: Layout, schema: T.StructType) -> DataFrame:
    """The stored table."""
    return _stored(spark, path, layout, schema).drop(PART)


def _stored(spark: SparkSession, path: str, layout: Layout, schema: T.StructType) -> DataFrame:
    layout = _found(spark, path, layout) or layout
    fields = [T.StructField(f.name, f.dataType, True) for f in schema.fields]
    return spark.read.schema(T.StructType([*fields, T.StructField(PART, T.StringType())])).parquet(layout.folder(path))


def merge(spark: SparkSession, path: str, layout: Layout, changes: DataFrame, schema: T.StructType, seq: str = "change_seq") -> list[str]:
    """I1 on a stored table: insert or replace by key, the last change of a key wins.

    ``changes`` has the table's columns and ``seq``.  Returns the folders that
    were rewritten (a driver-side list, as the file index of the table is).
    """
    key, names = layout.key, schema.names
    scratch_dir(spark)
    layout = _found(spark, path, layout) or layout
    stored = _stored(spark, path, layout, schema)
    last = changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in names if c != key]), F.col(seq)).alias("__l")).select(key, "__l.*")
    last = last.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).withColumn(PART, layout.part()).checkpoint()
    touched = last.select(PART)
    if layout.column:
        touched = touched.unionAll(stored.select(key, PART).join(last.select(key), key, "left_semi").select(PART))
    touched = sorted(r[0] for r in touched.distinct().collect())
    kept = stored.where(F.col(PART).isin(touched)).join(last.select(key), key, "left_anti")
    merged = _dealt(kept.select(*names, PART).unionByName(last), layout).checkpoint()
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(layout.folder(path))
    if layout.column:  # folders that all rows moved out of
        left = {r[0] for r in merged.select(PART).distinct().collect()}
        for part in touched:
            if part not in left:
                name = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(part)
                files.remove(spark, f"{layout.folder(path)}/{PART}={name}")
    return touched
