"""Deletes by the schema's graph of foreign keys."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import types as T_

from innkeep.operators import changes as C
from innkeep.sources.schema import SPECS, Col, ForeignKey, TableSpec

from .helpers import make_tables

t = dt.datetime


def name(c, nullable=False):
    return Col(c, T_.StringType(), nullable=nullable)


def graph(*edges):
    """Tables with an id and their foreign keys: (child, column, parent, action)."""
    tables = sorted({x for c, _, p, _ in edges for x in (c, p)})
    return {
        n: TableSpec(n, (name("id"), *[name(col, True) for c, col, _, _ in edges if c == n]), ("id",), tuple(ForeignKey(col, p, "id", a) for c, col, p, a in edges if c == n))
        for n in tables
    }


def frames(spark, specs, rows):
    return {n: spark.createDataFrame(rows.get(n, []), s.struct()) for n, s in specs.items()}


def ids(df):
    return sorted(tuple(r) for r in df.collect())


def feed(spark, keys):
    return spark.createDataFrame([(k + 1, x) for k, x in enumerate(keys)], "change_seq long, id string")


def test_actions_are_followed_through_cascades(spark):
    specs = graph(("b", "a_id", "a", "cascade"), ("c", "b_id", "b", "cascade"), ("d", "c_id", "c", "restrict"), ("e", "c_id", "c", "set null"), ("e", "a_id", "a", "set null"))
    tables = frames(spark, specs, {
        "a": [("a1",), ("a2",), ("a3",)],
        "b": [("b1", "a1"), ("b2", "a2"), ("b3", "a2"), ("b4", None)],
        "c": [("c1", "b1"), ("c2", "b2"), ("c3", "b3"), ("c4", "b4")],
        "d": [("d1", "c1"), ("d2", "c4")],
        "e": [("e1", "c2", "a1"), ("e2", "c1", "a2"), ("e3", "c4", "a3")],
    })
    new, rejects = C.remove_rows(tables, "a", feed(spark, ["a1", "a2", "a2", "a9"]), "id", specs)
    # a1 is held by d1 through b1 and c1; a2 takes b2, b3, c2, c3 with it
    assert ids(rejects.select("change_seq", "reason")) == [(1, "referenced by d.c_id"), (3, "not found"), (4, "not found")]
    assert ids(new["a"]) == [("a1",), ("a3",)]
    assert ids(new["b"].select("id")) == [("b1",), ("b4",)]
    assert ids(new["c"].select("id")) == [("c1",), ("c4",)]
    assert {tuple(r) for r in new["e"].collect()} == {("e1", None, "a1"), ("e2", "c1", None), ("e3", "c4", "a3")}
    assert "d" not in new


def test_a_new_child_table_is_protected_without_more_code(spark):
    specs = {**SPECS, "loyalty": TableSpec("loyalty", (name("CardNo"), name("CustomerID")), ("CardNo",), (ForeignKey("CustomerID", "customer", "CustomerID", "restrict"),))}
    tables = make_tables(spark, customer=[("C1", "A", "B", "1"), ("C2", "C", "D", "2")])
    tables["loyalty"] = spark.createDataFrame([("X", "C1")], specs["loyalty"].struct())
    changes = spark.createDataFrame([(1, "C1"), (2, "C2")], "change_seq long, customer_id string")
    new, rejects = C.remove_rows(tables, "customer", changes, "customer_id", specs)
    assert ids(rejects.select("reason")) == [("referenced by loyalty.CustomerID",)]
    assert ids(new["customer"].select("CustomerID")) == [("C1",)]


def test_circles_raise(spark):
    specs = graph(("b", "a_id", "a", "cascade"), ("a", "b_id", "b", "cascade"))
    with pytest.raises(ValueError, match="circle"):
        C.remove_rows(frames(spark, specs, {}), "a", feed(spark, ["a1"]), "id", specs)


def test_staff_keep_what_stays_refer_to(spark):
    tables = make_tables(
        spark,
        staff=[("S1", "A", "B", "Front Desk"), ("S2", "C", "D", "Front Desk"), ("S3", "E", "F", "Housekeeping")],
        frontdesk=[("S1", "Morning"), ("S2", "Evening")],
        housekeeping=[("S3", "Morning", 1)],
        room=[("R1", "S", D("1.00"), "Vacant", "S3")],
        reservation=[("V1", "R1", "C1", "S1", t(2024, 1, 1), None)],
        reservation_request=[("Q1", "C1", "S", t(2024, 1, 1), t(2024, 1, 2), "Approved", "R1", "S2", dt.date(2024, 1, 1))],
    )
    changes = spark.createDataFrame([(1, "S1"), (2, "S2"), (3, "S3")], "change_seq long, staff_id string")
    new, rejects = C.remove_staff(tables, changes)
    assert sorted(new) == ["frontdesk", "housekeeping", "reservation_request", "room", "staff"]
    assert ids(rejects.select("staff_id", "reason")) == [("S1", "referenced by reservation.StaffID")]
    assert ids(new["staff"].select("StaffID")) == ids(new["frontdesk"].select("StaffID")) == [("S1",)]
    assert new["housekeeping"].count() == 0
    assert new["room"].first().HousekeeperID is None and new["reservation_request"].first().StaffID is None
