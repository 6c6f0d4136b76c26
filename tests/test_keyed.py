"""Upserts into stored tables that rewrite only what a batch touches."""

import datetime as dt
import os

import pytest

from innkeep.operators.changes import upsert
from innkeep.sources import keyed
from innkeep.sources.keyed import Layout

EVENTS = "EventID long, EventDate date, Host string"


def day(k):
    return dt.date(2024, 1, 1) + dt.timedelta(days=k)


def snapshot(root):
    """Data files and their times."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


CASES = {
    "range": (Layout("EventID", width=10), [(12, day(1), "new", 2), (12, day(1), "late", 1), (105, day(3), "added", 3)], ["1", "10"]),
    "date": (Layout("EventID", column="EventDate"), [(12, day(0), "moved", 1), (205, day(9), "added", 2), (7, day(2), "same day", 3)], ["2024-01-01", "2024-01-03", "2024-01-10"]),
    "hash": (Layout("EventID", buckets=16), [(12, day(1), "new", 1)], None),
}


@pytest.mark.parametrize("kind", CASES)
def test_untouched_files_stay_and_the_result_is_the_upsert(spark, tmp_path, kind):
    layout, changes, parts = CASES[kind]
    table = spark.createDataFrame([(k, day(k % 5), f"h{k}") for k in range(100)], EVENTS)
    feed = spark.createDataFrame(changes, EVENTS + ", change_seq long")
    path = str(tmp_path / "events")
    keyed.store(table, path, layout)
    assert rows_of(keyed.load(spark, path, layout, table.schema)) == rows_of(table)
    before = snapshot(path)
    touched = keyed.merge(spark, path, layout, feed, table.schema)
    assert parts is None and len(touched) == 1 or touched == parts
    after = snapshot(path)
    same = {f: m for f, m in before.items() if f.split(keyed.PART + "=")[1].split("/")[0] not in touched}
    assert same and same.items() <= after.items() and not (before.keys() - same.keys()) & after.keys()
    want = rows_of(upsert(table, feed, "EventID"))
    assert rows_of(keyed.load(spark, path, layout, table.schema)) == want
    # the same batch again changes nothing
    keyed.merge(spark, path, layout, feed, table.schema)
    assert rows_of(keyed.load(spark, path, layout, table.schema)) == want


def test_a_folder_that_all_rows_leave_is_emptied(spark, tmp_path):
    layout, path = Layout("EventID", column="EventDate"), str(tmp_path / "events")
    table = spark.createDataFrame([(1, day(0), "a"), (2, day(1), "b"), (3, None, "c")], EVENTS)
    keyed.store(table, path, layout)
    feed = spark.createDataFrame([(1, day(1), "a", 1), (3, day(1), "c", 2)], EVENTS + ", change_seq long")
    assert keyed.merge(spark, path, layout, feed, table.schema) == ["2024-01-01", "2024-01-02", "null"]
    assert rows_of(keyed.load(spark, path, layout, table.schema)) == [(1, day(1), "a"), (2, day(1), "b"), (3, day(1), "c")]


def test_only_touched_folders_are_read(spark, tmp_path):
    layout, path = Layout("EventID", width=10), str(tmp_path / "events")
    keyed.store(spark.createDataFrame([(k, day(k % 5), "h") for k in range(100)], EVENTS), path, layout)
    stored = keyed._stored(spark, path, layout, spark.createDataFrame([], EVENTS).schema)
    assert len(stored.where(stored[keyed.PART].isin(["3", "9"])).inputFiles()) <= len(stored.inputFiles())
    plan = stored.where(stored[keyed.PART].isin(["3"]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "__part" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_layout_has_one_kind():
    with pytest.raises(ValueError):
        Layout("k", width=3, buckets=4)
    with pytest.raises(ValueError):
        Layout("k")


def test_folders_and_files_are_bounded(spark, tmp_path, monkeypatch):
    """Ranges grow with the table's ids, and a merge writes one file a folder, not one a folder and task."""
    monkeypatch.setattr(keyed, "FOLDERS", 8)
    layout, path = Layout("EventID", width=10), str(tmp_path / "events")
    table = spark.range(0, 1000, 1, 7).selectExpr("id AS EventID", "date_add(DATE'2024-01-01', int(id % 5)) AS EventDate", "concat('h', id) AS Host")
    feed = table.where("EventID % 3 = 0").selectExpr("EventID + 500 AS EventID", "EventDate", "'new' AS Host", "EventID AS change_seq").repartition(6)
    keyed.store(table, path, layout)
    assert len(snapshot(path)) <= 8 and os.listdir(path) == ["width=10x16"]
    touched = keyed.merge(spark, path, layout, feed, table.schema)
    assert sorted(map(int, touched)) == list(range(3, 10)) and len(snapshot(path)) <= 10
    assert rows_of(keyed.load(spark, path, layout, table.schema)) == rows_of(upsert(table, feed, "EventID"))
    with pytest.raises(Exception, match="(?i)already exists"):
        keyed.store(table, path, layout)
    keyed.store(table.where("EventID < 20"), path, layout, "overwrite")
    assert os.listdir(path) == ["width=10"] and keyed.load(spark, path, layout, table.schema).count() == 20
    wide = Layout("EventID", width=1)
    monkeypatch.setattr(keyed, "FOLDER_IDS", 4)  # ids far apart don't end up in one folder
    keyed.store(table, str(tmp_path / "wide"), wide)
    assert os.listdir(tmp_path / "wide") == ["width=1x4"]
