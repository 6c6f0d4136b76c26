"""Room status kept current from a stream of stay changes (I7, streaming).

The model's row triggers set a room's status after every stay insert or
update.  As a stream:

1. ``stays`` is a streaming DataFrame of stay changes (``RoomID``,
   ``CheckOut``, ``change_seq``; optional ``RoomStatus`` override).
2. A streaming aggregation keeps, per room, the change with the highest
   ``change_seq`` seen so far (``max_by``) in Spark's state store.  The
   state is one row per room, so it is bounded by the room table, and a
   late change with a lower sequence number cannot overwrite a newer one.
3. In ``update`` mode each micro-batch emits only the rooms whose latest
   change moved.  ``foreachBatch`` appends these rows, and no others, to a
   :class:`~innkeep.sources.change_log.ChangeLog` under the batch's number.
   Every ``compact_every`` batches the log is folded into a new base table and
   old files are deleted.

A retried batch (after an executor or driver loss) writes the same folder
again, or nothing if a base holds it already, so the sink is idempotent and the
checkpoint gives exactly-once results.  The checkpoint and the log belong in the
shared folder the cluster names in ``spark.checkpoint.dir``; see
:func:`innkeep.session.checkpoint_dir`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import SEQ
from ..sources.change_log import ChangeLog

OCCUPIED, VACANT = "Occupied", "Vacant"


def latest_status(stays: DataFrame, seq: str = SEQ) -> DataFrame:
    """Per room: status implied by its latest change, and that change's number."""
    derived = F.when(F.col("CheckOut").isNull(), OCCUPIED).otherwise(VACANT)
    if "RoomStatus" in stays.columns:
        derived = F.coalesce(F.col("RoomStatus"), derived)
    return stays.groupBy(F.col("RoomID").alias("RoomNo")).agg(
        F.max_by(derived, F.col(seq)).alias("RoomStatus"), F.max(seq).alias("last_seq")
    )


def room_log(root: str, keep: int = 1) -> ChangeLog:
    """The log of room status under ``root``; its :meth:`~ChangeLog.create` takes the room table."""
    return ChangeLog(root, "RoomNo", ("RoomStatus",), keep)


def apply_batch(log: ChangeLog, compact_every: int) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function: changed rooms go to the log; now and then the log is compacted."""

    def run(updates: DataFrame, batch_id: int) -> None:
        log.append(updates, batch_id)
        if (batch_id + 1) % compact_every == 0:
            log.compact(updates.sparkSession)

    return run


def start(stays: DataFrame, log: ChangeLog, checkpoint: str, trigger: dict | None = None, compact_every: int = 50) -> StreamingQuery:
    """Start the stream.  ``trigger`` e.g. ``{"availableNow": True}`` or
    ``{"processingTime": "30 seconds"}``.  A stream goes on with the log of its
    checkpoint, or starts anew with both."""
    writer = (
        latest_status(stays)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(apply_batch(log, compact_every))
    )
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
