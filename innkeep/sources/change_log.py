"""A table kept current by a log of changed rows: merge on read, compaction, retention.

Layout under ``root`` (a shared folder)::

    base/batches=<n>/    the whole table, with the first n batches folded in
    log/batch=<k>/       the rows that batch k changed: key, new values

* :meth:`ChangeLog.append` writes the changed rows of a batch, and no others.
  The folder is named by the batch and overwritten, so a batch that is run again
  writes the same; one that a base already holds is computed, but not written.
* :meth:`ChangeLog.read` is the newest base, each row with its values of the
  last batch that changed it: one left join with the log, which is aggregated
  to a row per key first (a key changed by every batch is combined map-side).
* :meth:`ChangeLog.compact` folds the batches into a new base.  A base counts
  once its write is committed; what a lost driver left half-written is ignored
  by readers and overwritten by the next compaction.
* :meth:`ChangeLog.expire` then deletes bases older than the newest ``keep + 1``
  and batches that every remaining base holds.  Readers of a kept base go on.

A reader opens one base and at most the batches since; the number of batches
between two compactions bounds both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import files

BATCH = "__batch"


@dataclass(frozen=True)
class ChangeLog:
    """``columns`` of the table are set by changes; rows are named by ``key``."""

    root: str
    key: str
    columns: tuple[str, ...]
    keep: int = 1

    def _base(self, batches: int) -> str:
        return f"{self.root.rstrip('/')}/base/batches={batches:012d}"

    def _log(self, batch: int) -> str:
        return f"{self.root.rstrip('/')}/log/batch={batch:012d}"

    def _numbers(self, spark: SparkSession, kind: str) -> list[int]:
        """Numbers of the committed folders of a kind, ascending."""
        folder = f"{self.root.rstrip('/')}/{kind}"
        return [int(n.split("=")[1]) for n in files.names(spark, folder) if "=" in n and files.complete(spark, f"{folder}/{n}")]

    def create(self, table: DataFrame) -> None:
        """Write the table before all batches, unless the log has a base."""
        if not self._numbers(table.sparkSession, "base"):
            table.write.mode("overwrite").parquet(self._base(0))

    def folded(self, spark: SparkSession) -> int:
        """Number of batches that the newest base holds; without a base this raises."""
        bases = self._numbers(spark, "base")
        if not bases:
            raise FileNotFoundError(f"no base under {self.root}")
        return bases[-1]

    def pending(self, spark: SparkSession) -> list[int]:
        """The committed batches since the newest base; one missing between them raises, as its changes would be lost."""
        start = self.folded(spark)
        found = [k for k in self._numbers(spark, "log") if k >= start]
        if found != list(range(start, start + len(found))):
            raise FileNotFoundError(f"batches {found} of {self.root} don't follow on {start}")
        return found

    def append(self, changes: DataFrame, batch: int) -> None:
        """The rows that ``batch`` changed (one per key), written under its number."""
        spark = changes.sparkSession
        done = self.folded(spark)
        if batch < done:
            # computed all the same: a stream's state is committed by its tasks
            changes.write.format("noop").mode("overwrite").save()
            return
        if batch > done and not files.complete(spark, self._log(batch - 1)):
            raise FileNotFoundError(f"batch {batch - 1} of {self.root} is missing")
        changes.select(self.key, *self.columns).write.mode("overwrite").parquet(self._log(batch))

    def _merged(self, spark: SparkSession, base: int, batches: list[int]) -> DataFrame:
        table = spark.read.parquet(self._base(base))
        if not batches:
            return table
        types = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in (self.key, *self.columns))
        rows = None
        for k in batches:
            part = spark.read.schema(types).parquet(self._log(k)).withColumn(BATCH, F.lit(k))
            rows = part if rows is None else rows.unionAll(part)
        last = rows.groupBy(F.col(self.key).alias("__k")).agg(F.max_by(F.struct(*self.columns), F.col(BATCH)).alias("__v"))
        new = [F.when(F.col("__k").isNotNull(), F.col(f"__v.{c}")).otherwise(F.col(c)).alias(c) if c in self.columns else F.col(c) for c in table.columns]
        return table.join(last, F.col(self.key) == F.col("__k"), "left").select(*new)

    def read(self, spark: SparkSession) -> DataFrame:
        """The table with every committed batch."""
        return self._merged(spark, self.folded(spark), self.pending(spark))

    def compact(self, spark: SparkSession) -> int:
        """Fold the pending batches into a new base; returns the number of batches it holds."""
        start, batches = self.folded(spark), self.pending(spark)
        if batches:
            self._merged(spark, start, batches).write.mode("overwrite").parquet(self._base(start + len(batches)))
            self.expire(spark)
        return start + len(batches)

    def expire(self, spark: SparkSession) -> None:
        """Delete bases beyond the newest ``keep + 1``, half-written older ones, and batches that all kept bases hold."""
        bases = self._numbers(spark, "base")
        kept = bases[-(self.keep + 1) :]
        root = self.root.rstrip("/")
        for name in files.names(spark, f"{root}/base"):
            n = int(name.split("=")[1])
            if n not in kept and n < kept[-1]:
                files.remove(spark, f"{root}/base/{name}")
        for name in files.names(spark, f"{root}/log"):
            if int(name.split("=")[1]) < kept[0]:
                files.remove(spark, f"{root}/log/{name}")
