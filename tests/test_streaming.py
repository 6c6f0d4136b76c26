"""The room-status stream (I7 under Structured Streaming) and its change log."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest

from innkeep.operators.changes import derive_room_status
from innkeep.sources import files
from innkeep.streaming import room_status as RS

t = dt.datetime
STAYS = "RoomID string, CheckOut timestamp_ntz, change_seq long"
ROOMS = "RoomNo string, RoomType string, RoomRate decimal(10,2), RoomStatus string, HousekeeperID string"


def rooms_of(spark, n=3, status="Vacant"):
    return spark.createDataFrame([(f"R{k}", "S", D("1.00"), status, None) for k in range(1, n + 1)], ROOMS)


def statuses(df):
    return {r.RoomNo: r.RoomStatus for r in df.collect()}


def run_stream(spark, src, log, checkpoint, compact_every=50):
    stream = spark.readStream.schema(STAYS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    query = RS.start(stream, log, checkpoint, {"availableNow": True}, compact_every)
    assert query.awaitTermination(180)


def put(spark, src, k, rows):
    spark.createDataFrame(rows, STAYS).coalesce(1).write.parquet(f"{src}/part{k:03d}")


def test_stream_keeps_last_change_per_room(spark, tmp_path):
    rooms = rooms_of(spark)
    src, log = str(tmp_path / "stays"), RS.room_log(str(tmp_path / "log"))
    log.create(rooms)
    batches = [
        [("R1", None, 1), ("R2", t(2024, 1, 2), 2)],
        [("R1", t(2024, 1, 3), 5)],
        [("R1", None, 3)],  # late: lower seq than the change already seen
    ]
    for i, rows in enumerate(batches):
        put(spark, src, i, rows)
    run_stream(spark, src, log, str(tmp_path / "ckpt"))
    batch = derive_room_status(rooms, spark.createDataFrame([r for b in batches for r in b], STAYS))
    assert statuses(log.read(spark)) == statuses(batch) == {"R1": "Vacant", "R2": "Vacant", "R3": "Vacant"}


def test_a_batch_writes_changed_rooms_only(spark, tmp_path):
    src, log = str(tmp_path / "stays"), RS.room_log(str(tmp_path / "log"))
    log.create(rooms_of(spark, 50))
    put(spark, src, 0, [("R1", None, 1), ("R2", None, 2)])
    put(spark, src, 1, [("R2", t(2024, 1, 2), 3)])
    run_stream(spark, src, log, str(tmp_path / "ckpt"))
    assert statuses(spark.read.parquet(log._log(0))) == {"R1": "Occupied", "R2": "Occupied"}
    assert statuses(spark.read.parquet(log._log(1))) == {"R2": "Vacant"}
    assert files.names(spark, f"{log.root}/base") == ["batches=000000000000"]


@pytest.mark.parametrize("stop", ["before the base is whole", "before old files go", "before the batch is done"])
def test_replay_with_a_restart_in_mid_compaction_equals_the_batch_job(spark, tmp_path, monkeypatch, stop):
    """The driver is lost during a compaction; the stream is started again and goes on."""
    rng = random.Random(7)
    rooms = rooms_of(spark, 9, "Occupied")
    src, log, checkpoint = str(tmp_path / "stays"), RS.room_log(str(tmp_path / "log"), keep=0), str(tmp_path / "ckpt")
    log.create(rooms)
    seqs = rng.sample(range(1, 200), 40)
    rows = [(f"R{rng.randint(1, 8)}", rng.choice([None, t(2024, 1, 1)]), s) for s in seqs]
    for k in range(5):
        put(spark, src, k, rows[8 * k : 8 * k + 8])

    class Lost(Exception):
        pass

    whole, expire = RS.ChangeLog.compact, RS.ChangeLog.expire

    def lost(self, spark):
        if stop == "before the base is whole":
            path = self._base(self.folded(spark) + len(self.pending(spark)))
            rooms.limit(2).write.parquet(path)
            files.remove(spark, f"{path}/_SUCCESS")
        elif stop == "before old files go":
            monkeypatch.setattr(RS.ChangeLog, "expire", lambda *a: None)
            whole(self, spark)
        else:
            whole(self, spark)
        raise Lost

    monkeypatch.setattr(RS.ChangeLog, "compact", lost)
    with pytest.raises(Exception, match="Lost"):
        run_stream(spark, src, log, checkpoint, compact_every=2)
    monkeypatch.setattr(RS.ChangeLog, "compact", whole)
    monkeypatch.setattr(RS.ChangeLog, "expire", expire)
    run_stream(spark, src, log, checkpoint, compact_every=2)
    want = statuses(derive_room_status(rooms, spark.createDataFrame(rows, STAYS)))
    assert statuses(log.read(spark)) == want and want["R9"] == "Occupied"
    # five batches: a base of four, and the fifth in the log; the rest is gone
    assert files.names(spark, f"{log.root}/base") == ["batches=000000000004"]
    assert files.names(spark, f"{log.root}/log") == ["batch=000000000004"]


def test_restart_and_batch_replay_are_idempotent(spark, tmp_path):
    src, log, checkpoint = str(tmp_path / "stays"), RS.room_log(str(tmp_path / "log")), str(tmp_path / "ckpt")
    log.create(rooms_of(spark, 2))
    put(spark, src, 0, [("R1", None, 1)])
    run_stream(spark, src, log, checkpoint)
    first = statuses(log.read(spark))
    assert first == {"R1": "Occupied", "R2": "Vacant"}
    # restart from the checkpoint with no new files: nothing is processed again
    run_stream(spark, src, log, checkpoint)
    assert statuses(log.read(spark)) == first and log.pending(spark) == [0]
    # a retried micro-batch (same number, same rows) writes the same folder
    updates = spark.createDataFrame([("R1", "Occupied")], "RoomNo string, RoomStatus string")
    log.append(updates, 0)
    assert statuses(log.read(spark)) == first
    # and nothing once a base holds it
    assert log.compact(spark) == 1 and log.pending(spark) == []
    log.append(spark.createDataFrame([("R1", "Vacant")], "RoomNo string, RoomStatus string"), 0)
    assert statuses(log.read(spark)) == first
    # a log that exists isn't created anew
    log.create(rooms_of(spark, 2))
    assert statuses(log.read(spark)) == first


def test_readers_of_a_kept_base_go_on(spark, tmp_path):
    log = RS.room_log(str(tmp_path / "log"), keep=1)
    log.create(rooms_of(spark, 2))
    one = lambda status: spark.createDataFrame([("R1", status)], "RoomNo string, RoomStatus string")
    log.append(one("Occupied"), 0)
    open_reader = log.read(spark)
    log.compact(spark)
    assert statuses(open_reader) == {"R1": "Occupied", "R2": "Vacant"}
    log.append(one("Vacant"), 1)
    log.compact(spark)
    assert files.names(spark, f"{log.root}/base") == ["batches=000000000001", "batches=000000000002"]
    assert files.names(spark, f"{log.root}/log") == ["batch=000000000001"]


def test_a_missing_batch_or_base_raises(spark, tmp_path):
    log = RS.room_log(str(tmp_path / "log"))
    updates = spark.createDataFrame([("R1", "Occupied")], "RoomNo string, RoomStatus string")
    with pytest.raises(FileNotFoundError):
        log.append(updates, 0)
    log.create(rooms_of(spark, 2))
    log.append(updates, 0)
    with pytest.raises(FileNotFoundError):
        log.append(updates, 2)
    log.append(updates, 1)
    files.remove(spark, log._log(0))
    with pytest.raises(FileNotFoundError):
        log.read(spark)
