"""Data-quality job (J1-J7) on hand-made bad rows."""

import datetime as dt
from decimal import Decimal as D

from innkeep.operators import quality

from .helpers import make_tables

t = dt.datetime


def test_every_rule_reports_its_bad_rows(spark):
    T = make_tables(
        spark,
        staff=[("HK01", "Ama", "Owusu", "Housekeeping"), ("FD01", "Kofi", "Mensah", "Chef"),
               ("FD02", "A" * 21, "B", "Front Desk")],
        housekeeping=[("HK01", "Morning", 25), ("HK09", "Night", 3)],
        frontdesk=[("FD01", "Evening")],
        customer=[("CU01", "Yaw", "Asare", "02412345678"), ("CU01", "Dup", "Row", "1")],
        room=[("R101", "Single", D("250.00"), "Vacant", "HK01"), ("R102", "Single", D("300.00"), "Dirty", "HK07")],
        reservation=[("RES1", "R101", "CU01", "FD01", t(2024, 1, 2), t(2024, 1, 1)),
                     ("RES2", "R999", "CU01", "FD01", t(2024, 1, 1), None)],
        customer_feedback=[("FB1", "CU01", 0, "meh", dt.date(2024, 1, 1))],
    )
    got = {(r.table_name, r.rule, r.column_name, r.row_key) for r in quality.check_all(T).collect()}
    want = {
        ("customer", "unique", "CustomerID", "CU01"),
        ("staff", "enum", "StaffRole", "FD01"),
        ("staff", "size", "StaffFName", "FD02"),
        ("housekeeping", "range", "AssignedFloor", "HK01"),
        ("housekeeping", "enum", "Shift", "HK09"),
        ("housekeeping", "foreign_key", "StaffID", "HK09"),
        ("customer", "size", "PhoneNumber", "CU01"),
        ("room", "enum", "RoomStatus", "R102"),
        ("room", "foreign_key", "HousekeeperID", "R102"),
        ("reservation", "stay_order", "CheckOut", "RES1"),
        ("reservation", "foreign_key", "RoomID", "RES2"),
        ("customer_feedback", "range", "Rating", "FB1"),
    }
    assert want <= got, sorted(want - got)
    # nothing else is reported
    assert got - want == set(), sorted(got - want)


def test_summary_counts_per_rule(spark):
    T = make_tables(
        spark,
        room=[("R1", "S", D("1.00"), "Dirty", None), ("R2", "S", D("1.00"), "Dirty", None), ("R3", "S", D("1.00"), "Vacant", None)],
    )
    rows = [(r.table_name, r.rule, r.column_name, r.violations) for r in quality.summary(quality.check_all(T)).collect()]
    assert rows == [("room", "enum", "RoomStatus", 2)]


def test_refreshed_foreign_keys_equal_the_full_check_after_random_batches(spark):
    import random

    from innkeep.sources.schema import SPECS

    names = ("customer", "customer_feedback", "restaurant", "invoice", "restaurant_order")
    rng = random.Random(11)
    day = dt.date(2024, 1, 1)
    rows = {n: {} for n in names}

    def some_id(k=9):
        return f"i{rng.randrange(k)}"

    def new_row(table, key):
        return {
            "customer": lambda: (key, "A", "B", "1"),
            "restaurant": lambda: (key, "R", 5),
            "customer_feedback": lambda: (key, some_id(), 3, "ok", day),
            "invoice": lambda: (key, None, some_id(), D("1.00"), D("0.00")),
            "restaurant_order": lambda: (key, some_id(), some_id(), rng.choice([None, some_id()]), "x"),
        }[table]()

    def frame(table, values):
        return spark.createDataFrame(list(values), SPECS[table].struct())

    def checked():
        tables = {n: frame(n, rows[n].values()) for n in names}
        return {**make_tables(spark), **tables}

    for n in names:
        for k in range(6):
            rows[n][f"i{k}"] = new_row(n, f"i{k}")
    children = [n for n in names if SPECS[n].foreign_keys]
    as_set = lambda df: sorted(map(tuple, df.collect()))

    def full(tables):
        return as_set(quality._union([f for n in children for f in quality.check_foreign_keys(tables, SPECS[n])], spark))

    tables = checked()
    previous = quality._union([f for n in children for f in quality.check_foreign_keys(tables, SPECS[n])], spark)
    known = spark.createDataFrame(previous.collect(), previous.schema)
    for _ in range(4):
        deltas = {}
        for n in rng.sample(names, 3):
            out = rng.sample(sorted(rows[n]), min(2, len(rows[n])))
            put = {k: new_row(n, k) for k in {some_id(12) for _ in range(2)} - set(out)}
            key = SPECS[n].key[0]
            deltas[n] = quality.Delta(frame(n, put.values()) if put else None, spark.createDataFrame([(k,) for k in out], f"{key} string"))
            rows[n] = {k: r for k, r in rows[n].items() if k not in out} | put
        tables = checked()
        got = quality.refresh_foreign_keys(known, tables, deltas)
        assert as_set(got) == full(tables)
        known = spark.createDataFrame(got.collect(), previous.schema)


def test_refresh_reads_children_only_where_parents_went(spark, tmp_path):
    """A batch of new stays reads the stays' new rows and the parents, not the stays."""
    T = make_tables(spark)
    stays = [("RES1", "R1", "CU1", "FD1", t(2024, 1, 1), None)]
    put = make_tables(spark, reservation=stays)["reservation"]
    put.write.parquet(str(tmp_path / "reservation"))
    after = {**T, "reservation": spark.read.parquet(str(tmp_path / "reservation"))}
    got = quality.refresh_foreign_keys(quality._union([], spark), after, {"reservation": quality.Delta(put)})
    assert {r.column_name for r in got.collect()} == {"RoomID", "CustomerID", "StaffID"}
    assert got.inputFiles() == []


def test_a_task_of_the_unique_check_reads_a_bounded_part(spark):
    """The registered queries bound what a task reads of a shuffle, unless the session names a size."""
    import __spark_entry__ as entry

    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size, None)
    try:
        spark.conf.unset(size)
        entry._settings(spark)
        assert spark.conf.get(size) == "16m"
        spark.conf.set(size, "1m")
        entry._settings(spark)
        assert spark.conf.get(size) == "1m"
    finally:
        spark.conf.set(size, before) if before else spark.conf.unset(size)
