"""Sources and sinks (A1-A4)."""

import json

import pytest

from pyspark.sql import types as T

from innkeep.sources import tables
from innkeep.sources.tables import bulk_load, load_lines, parse_changes, write_report

from .conftest import SF_SMALL


def test_load_tables_has_declared_columns(spark, small_tables):
    from innkeep.sources.schema import SPECS

    assert set(small_tables) == set(SPECS)
    for name, df in small_tables.items():
        assert df.columns == SPECS[name].names, name


def test_read_changes_keeps_malformed_records(spark, tmp_path):
    p = tmp_path / "changes.json"
    p.write_text('{"change_seq": 1, "reservation_id": "RES1"}\n{"change_seq": oops}\n')
    schema = T.StructType([T.StructField("change_seq", T.LongType()), T.StructField("reservation_id", T.StringType())])
    good, bad = tables.read_changes(spark, str(p), schema)
    assert [r.reservation_id for r in good.collect()] == ["RES1"]
    assert bad.count() == 1 and bad.first().reason == "malformed record"


def test_write_report_json(spark, small_tables, tmp_path):
    from innkeep.operators.reports import room_inventory_report

    out = tmp_path / "report"
    tables.write_report(room_inventory_report(small_tables), str(out))
    lines = [json.loads(x) for f in out.glob("part-*.json") for x in f.read_text().splitlines()]
    assert len(lines) == room_inventory_report(small_tables).count()
    assert set(lines[0]) == {"RoomType", "TotalRooms", "AvgRate", "OccupiedCount", "VacantCount"}


def test_bulk_load_reports_violations(spark, tmp_path):
    csv = tmp_path / "rooms.csv"
    csv.write_text("RoomNo,RoomType,RoomRate,RoomStatus,HousekeeperID\nR101,Single,250.00,Vacant,\nR101,Suite,1.00,Dirty,\n")
    v = tables.bulk_load(spark, "room", str(csv), str(tmp_path / "room"))
    rules = sorted((r.rule, r.column_name) for r in v.collect())
    assert rules == [("enum", "RoomStatus"), ("unique", "RoomNo")]
    assert spark.read.parquet(str(tmp_path / "room")).count() == 0  # the key is repeated: neither row is stored


def test_bulk_load_keeps_unreadable_values_out(spark, tmp_path):
    csv = tmp_path / "stays.csv"
    csv.write_text("ReservationID,RoomID,CustomerID,StaffID,CheckIn,CheckOut\n"
                   "RES1,R1,C1,F1,2024-01-01 10:00:00,2024-13-45 11:00:00\nRES2,R1,C1,F1,2024-01-01 10:00:00,\n"
                   "RES3,R1,C1,F1,2024-01-02 10:00:00,2024-01-01 10:00:00\n")
    v = tables.bulk_load(spark, "reservation", str(csv), str(tmp_path / "reservation")).collect()
    assert sorted((r.rule, r.row_key) for r in v if r.rule != "unreadable") == [("stay_order", "RES3")]
    assert [r.bad_value[:4] for r in v if r.rule == "unreadable"] == ["RES1"]  # not an open stay
    assert [r.ReservationID for r in spark.read.parquet(str(tmp_path / "reservation")).collect()] == ["RES2"]


def test_missing_tables_raise(spark, small_tables, tmp_path):
    from pyspark.errors import AnalysisException

    from innkeep.operators import changes, quality
    from innkeep.sources.schema import SPECS

    with pytest.raises(AnalysisException):
        tables.read_tables(spark, str(tmp_path))["room"].count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.load_tables(spark, str(tmp_path))
    few = {k: small_tables[k] for k in ("customer", "customer_feedback", "reservation_request")}
    feed = spark.createDataFrame([(1, 1)], "change_seq long, customer_id long")
    with pytest.raises(KeyError):
        changes.remove_customers(few, feed)
    with pytest.raises(KeyError):
        quality.check_foreign_keys({"room": small_tables["room"]}, SPECS["room"])


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["RoomType", "TotalRooms", "AvgRate", "OccupiedCount", "VacantCount"]
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    assert E.queries()["halls"](spark, SF_SMALL).count() > 0


def test_read_tables_with_declared_schema(spark, tmp_path):
    from innkeep.sources.schema import SPECS

    from decimal import Decimal

    rows = [("R1", "Single", Decimal("250.00"), "Vacant", None)]
    spark.createDataFrame(rows, SPECS["room"].struct()).write.parquet(str(tmp_path / "room"))
    T = tables.read_tables(spark, str(tmp_path), names=["room"])
    assert set(T) == {"room"}
    # declared types (file sources report every column as nullable)
    assert [f.dataType for f in T["room"].schema] == [f.dataType for f in SPECS["room"].struct()]
    assert str(T["room"].first().RoomRate) == "250.00"


def test_write_report_csv_and_parquet(spark, small_tables, tmp_path):
    from innkeep.operators.reports import room_type_summary

    df = room_type_summary(small_tables)
    tables.write_report(df, str(tmp_path / "csv"), fmt="csv")
    tables.write_report(df, str(tmp_path / "pq"), fmt="parquet")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == df.count()
    assert sorted(spark.read.parquet(str(tmp_path / "pq")).collect()) == sorted(df.collect())


def test_write_report_partitioned(spark, small_tables, tmp_path):
    from innkeep.operators.views import upcoming_events

    df = upcoming_events(small_tables, "2024-01-15", ordered=False).select("EventID", "EventType")
    tables.write_report(df, str(tmp_path / "ev"), fmt="parquet", partition_by=["EventType"])
    folders = sorted(p.name for p in (tmp_path / "ev").iterdir() if p.is_dir())
    assert folders and all(f.startswith("EventType=") for f in folders)
    assert spark.read.parquet(str(tmp_path / "ev")).count() == df.count()


def test_write_tables_partitions_events_and_prunes(spark, small_tables, tmp_path):
    from innkeep.operators import views

    T = {k: small_tables[k] for k in ("event", "conference_hall", "customer")}
    tables.write_tables(T, str(tmp_path))
    assert any(p.name.startswith("EventDate=") for p in (tmp_path / "event").iterdir())
    stored = tables.read_tables(spark, str(tmp_path), id_type=T["event"].schema["EventID"].dataType, names=list(T))
    got = views.upcoming_events(stored, "2024-01-15", ordered=False)
    want = views.upcoming_events(T, "2024-01-15", ordered=False)
    assert sorted(got.collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(EventDate" in plan and "EventDate" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_json_feed_into_a_job(spark, tmp_path):
    import datetime as dt
    from decimal import Decimal

    from innkeep.operators import changes as C

    from .helpers import make_tables

    T = make_tables(
        spark,
        room=[("R1", "Single", Decimal("100.00"), "Occupied", None)],
        reservation=[("RES1", "R1", "C1", "F1", dt.datetime(2024, 1, 1, 14), None)],
    )
    p = tmp_path / "co.json"
    p.write_text('{"change_seq": 1, "reservation_id": "RES1", "check_out": "2024-01-03T10:00:00"}\n'
                 '{"change_seq": 2, "reservation_id": "RES1", "check_out": "2024-01-04 10:00:00"}\n'
                 '{"change_seq": 3, "reservation_id": "RES1", "check_out": "soon"}\n'
                 'not json\n')
    good, bad = tables.read_changes(spark, str(p), C.FEEDS["checkout_and_bill"])
    assert bad.count() == 1
    new, rej = C.checkout_and_bill(T, good, "2024-01-05 00:00:00")
    # "soon" does not parse: the database would refuse the update
    assert {r.change_seq: r.reason for r in rej.collect()} == {3: C.INVALID_DATE}
    # the last valid check-out wins: 2 days 20 h -> 3 nights at 100 x 1.125
    assert new["reservation"].first().CheckOut == dt.datetime(2024, 1, 4, 10)
    assert new["invoice"].first().AmountPayable == Decimal("337.50")


def test_write_report_json_keeps_nulls(spark, small_tables, tmp_path):
    from innkeep.operators.views import outstanding_invoices

    df = outstanding_invoices(small_tables, ordered=False).where("ReservationID IS NULL")
    tables.write_report(df, str(tmp_path / "inv"))
    lines = [json.loads(x) for f in (tmp_path / "inv").glob("part-*.json") for x in f.read_text().splitlines()]
    assert lines and all("ReservationID" in r and r["ReservationID"] is None for r in lines)


def test_bulk_load_checks_foreign_keys_against_parents(spark, tmp_path):
    from innkeep.sources.schema import SPECS

    staff = spark.createDataFrame([("HK01", "Ama", "Owusu", "Housekeeping")], SPECS["staff"].struct())
    hk = spark.createDataFrame([("HK01", "Morning", 2)], SPECS["housekeeping"].struct())
    csv = tmp_path / "rooms.csv"
    csv.write_text("RoomNo,RoomType,RoomRate,RoomStatus,HousekeeperID\nR101,Single,250.00,Vacant,HK01\n"
                   "R102,Single,250.00,Vacant,HK09\n")
    v = tables.bulk_load(spark, "room", str(csv), str(tmp_path / "room"), parents={"staff": staff, "housekeeping": hk})
    assert [(r.rule, r.column_name, r.row_key) for r in v.collect()] == [("foreign_key", "HousekeeperID", "R102")]


def test_load_lines_reads_quotes_and_reports_what_a_file_load_reports(spark, tmp_path):
    lines = ["1,Ama,Owusu,024", '2,"Kofi, Jr","O""Neil",025', "3,Esi", "", None, "  ", "4,,Boa,1", "5,A,B,C", "5,D,E,F", f"6,{'x' * 21},B,1"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    rows, violations = load_lines(df, "customer")
    assert [tuple(r) for r in rows.orderBy("CustomerID").collect()] == [("1", "Ama", "Owusu", "024"), ("2", "Kofi, Jr", 'O"Neil', "025")]
    got = {(r.rule, r.column_name, r.row_key, r.bad_value) for r in violations.collect()}
    path = str(tmp_path / "rows.csv")
    with open(path, "w") as f:
        f.write("\n".join(["CustomerID,CustomerFName,CustomerLName,PhoneNumber", *[x for x in lines if x]]))
    assert got == {(r.rule, r.column_name, r.row_key, r.bad_value) for r in bulk_load(spark, "customer", path, str(tmp_path / "out")).collect()}
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("CustomerID").collect()] == [tuple(r) for r in rows.orderBy("CustomerID").collect()]
    assert load_lines(df.limit(0), "customer")[1].collect() == []


def test_parse_changes_says_why_and_keeps_the_body(spark):
    lines = {
        '{"change_seq": 1, "invoice_no": "7", "amount": 12.50}': None,
        '{"change_seq": 2, "invoice_no": 7, "amount": "12.5"}': None,
        "{}": None,
        '{"change_seq": "1", "invoice_no": 7}': "type: change_seq",
        '{"change_seq": 1.5}': "type: change_seq",
        '{"change_seq": 1, "amount": 1e15}': "type: amount",
        '{"change_seq": 1, "inv': "malformed record",
        "[1, 2]": "malformed record",
        "null": "malformed record",
        "": "malformed record",
        None: "malformed record",
    }
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    good, bad = parse_changes(df, "change_seq long, invoice_no string, amount decimal(12,2)", keep_body=True)
    assert {r.raw: r.reason for r in bad.collect()} == {k: v for k, v in lines.items() if v}
    assert {r.body: (r.change_seq, r.invoice_no, r.amount and str(r.amount)) for r in good.collect()} == {
        '{"change_seq": 1, "invoice_no": "7", "amount": 12.50}': (1, "7", "12.50"),
        '{"change_seq": 2, "invoice_no": 7, "amount": "12.5"}': (2, "7", "12.50"),
        "{}": (None, None, None),
    }


def test_ordered_report_is_sorted_file_after_file(spark, small_tables, tmp_path):
    """Several files; by name, one after the other, they are the sorted report."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = small_tables["reservation"].select("ReservationID", "CustomerID", "CheckIn").repartition(5)
        write_report(df, str(tmp_path / "r"), order_by=[df.CheckIn.desc(), "ReservationID"])
        write_report(df, str(tmp_path / "p"), order_by=[df.CheckIn.desc()], partition_by=["CustomerID"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(f for f in (tmp_path / "r").iterdir() if f.suffix == ".json")
    rows = [json.loads(x) for f in files for x in f.read_text().splitlines()]
    assert len([f for f in files if f.stat().st_size]) > 1 and len(rows) == df.count()
    by_id = sorted(rows, key=lambda r: r["ReservationID"])
    assert rows == sorted(by_id, key=lambda r: r["CheckIn"], reverse=True)
    for folder in (tmp_path / "p").glob("CustomerID=*"):
        times = [json.loads(x)["CheckIn"] for f in sorted(folder.glob("*.json")) for x in f.read_text().splitlines()]
        assert times == sorted(times, reverse=True)
