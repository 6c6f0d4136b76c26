"""Scalar functions (H1-H16) on hand-made values."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from innkeep.functions import scalar as H


def _one(spark, expr, schema, *values):
    return spark.createDataFrame([values], schema).select(expr.alias("v")).first()["v"]


def test_full_name_null_part(spark):
    df = spark.createDataFrame([("Ann", "Lee"), ("Bo", None)], "f string, l string")
    assert [r.v for r in df.select(H.full_name("f", "l").alias("v")).collect()] == ["Ann Lee", None]


def test_room_tax_half_up(spark):
    assert _one(spark, H.room_tax("r"), "r decimal(10,2)", D("275.60")) == D("34.45")


def test_stay_nights_twelve_hours_does_not_add(spark):
    t = dt.datetime
    rows = [
        (t(2024, 1, 1, 12), t(2024, 1, 3, 0), 1),         # 1 day + exactly 12 h: 1
        (t(2024, 1, 1, 12), t(2024, 1, 2, 0, 0, 1), 1),   # 12 h 1 s: 0 days + 1
        (t(2024, 1, 1, 0), t(2024, 1, 1, 12), 1),         # exactly 12 h: max(1, 0)
        (t(2024, 1, 1, 0), t(2024, 1, 2, 12), 1),         # 1 day + exactly 12 h: 1
        (t(2024, 1, 1, 0), t(2024, 1, 2, 12, 0, 1), 2),   # 1 day + 12 h 1 s: 2
        (t(2024, 1, 1, 14), t(2024, 1, 5, 10), 4),        # 3 days 20 h
    ]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "i timestamp_ntz, o timestamp_ntz")
    got = [r.n for r in df.select(H.stay_nights("i", "o").alias("n")).collect()]
    want = []
    for a, b, _ in rows:
        d = b - a
        want.append(max(1, d.days + (1 if d.seconds > 3600 * 12 else 0)))
    assert got == want


def test_stay_charge_matches_binary_half_even(spark):
    # golden charges of the sample stays (nights, rate, charge)
    cases = [(4, "275", "1237.50"), (1, "300", "337.50"), (1, "375", "421.88"), (2, "1175", "2643.75"),
             (3, "525", "1771.88"), (8, "1225", "11025.00"), (6, "325", "2193.75"), (1, "325", "365.62")]
    df = spark.createDataFrame([(n, D(r)) for n, r, _ in cases], "n long, r decimal(10,2)")
    got = [r.c for r in df.select(H.stay_charge("n", "r").alias("c")).collect()]
    assert got == [D(c) for _, _, c in cases]


def test_stay_charge_random_against_python(spark):
    import random

    rnd = random.Random(7)
    cases = [(rnd.randint(1, 40), D(rnd.randint(100, 500000)) / 100) for _ in range(3000)]
    df = spark.createDataFrame(cases, "n long, r decimal(10,2)")
    got = [r.c for r in df.select(H.stay_charge("n", "r").alias("c")).collect()]
    want = [D(str(round((n * float(r)) * 1.125, 2))).quantize(D("0.01")) for n, r in cases]
    assert got == want


def test_stay_charge_default_rate(spark):
    df = spark.createDataFrame([(2, None), (2, D("0"))], "n long, r decimal(10,2)")
    assert [r.c for r in df.select(H.stay_charge("n", "r").alias("c")).collect()] == [D("225.00"), D("225.00")]


def test_labels(spark):
    df = spark.createDataFrame([(D("10.00"), D("10.00"), 3, None), (D("10.00"), D("2.50"), 5, dt.datetime(2024, 1, 1))],
                               "pay decimal(10,2), paid decimal(10,2), rating int, out timestamp_ntz")
    rows = df.select(
        H.payment_state("pay", "paid").alias("ps"),
        H.money_label("paid").alias("ml"),
        H.rating_stars("rating").alias("st"),
        H.stay_state("out").alias("ss"),
        H.money_label(F.lit(None).cast("decimal(10,2)")).alias("dash"),
    ).collect()
    assert rows[0].ps == H.FULLY_PAID and rows[1].ps == H.OPEN_INVOICE
    assert rows[1].ml == H.CURRENCY_PREFIX + "2.50"
    assert rows[0].st == "★★★☆☆" and rows[1].st == "★★★★★"
    assert rows[0].ss == H.STAY_ACTIVE and rows[1].ss == H.CHECKED_OUT
    assert rows[0].dash == H.DASH


def test_request_labels(spark):
    df = spark.createDataFrame([("Pending", None), ("Approved", "R101"), ("Declined", None)], "s string, r string")
    rows = df.select(H.request_label("s", "r", "guest").alias("g"), H.request_label("s", "r", "staff").alias("t")).collect()
    assert [r.g for r in rows] == ["Pending Review", "Approved & Confirmed", "Declined"]
    assert rows[1].t == "Approved (Room R101)"


def test_split_name(spark):
    names = ["  Cy  De Fa ", "Solo", " Solo ", "A\tB", "a\xa0b c", "Ama K. Mensah", "x\u3000y"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    first, rest = H.split_name("n")
    rows = df.select(first.alias("a"), rest.alias("b")).collect()
    want = []
    for n in names:
        parts = n.split(None, 1)
        want.append((parts[0], parts[1] if len(parts) > 1 else ""))
    assert [(r.a, r.b) for r in rows] == want


def test_token_rank_contains(spark):
    df = spark.createDataFrame([(" ak-x1 ", "Approved", "2x Jollof rice")], "t string, s string, d string")
    r = df.select(
        H.normalise_token("t").alias("tok"),
        H.status_rank("s").alias("rank"),
        H.status_rank(F.lit("Other")).alias("none"),
        H.contains_item("d", "JOLLOF").alias("has"),
    ).first()
    assert (r.tok, r.rank, r.none, r.has) == ("AK-X1", 2, 0, True)


def test_required_fields_truthiness(spark):
    df = spark.createDataFrame([("a", 1), ("", 1), ("a", 0), (None, 2)], "s string, n int")
    got = [r.m for r in df.select(H.required_fields({"s": "string", "n": "number"}).alias("m")).collect()]
    assert got == [False, True, True, True]


def test_stay_charge_small_products(spark):
    # products under 4 have fraction bits finer than 2^-50
    cases = [(n, D(r) / 100) for n in (1, 2, 3) for r in range(1, 400)]
    df = spark.createDataFrame(cases, "n long, r decimal(10,2)")
    got = [r.c for r in df.select(H.stay_charge("n", "r").alias("c")).collect()]
    want = [D(str(round((n * float(r)) * 1.125, 2))).quantize(D("0.01")) for n, r in cases]
    assert got == want


def test_stay_nights_ignores_session_time_zone(spark):
    rows = [(dt.datetime(2024, 3, 9, 14), dt.datetime(2024, 3, 11, 2, 30))]  # across a clock change in New York
    df = spark.createDataFrame(rows, "i timestamp_ntz, o timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert df.select(H.stay_nights("i", "o").alias("n")).first().n == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_trims_follow_python_and_javascript(spark):
    values = ["\t ak-x1 \n", " ab　", "﻿ab\u0085", "\x1cab\x1f", "plain"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select(H.py_strip("v").alias("p"), H.js_trim("v").alias("j"), H.normalise_token("v").alias("t")).collect()
    assert [r.p for r in rows] == [v.strip() for v in values]
    # JavaScript trims the byte-order mark but not NEL or the ASCII separators
    assert [r.j for r in rows] == ["ak-x1", "ab", "ab\u0085", "\x1cab\x1f", "plain"]
    assert rows[0].t == "AK-X1"


def test_default_label_falsy_and_null_forms(spark):
    df = spark.createDataFrame([("", 0), (None, None), ("Evening", 3)], "s string, f int")
    rows = df.select(H.default_label("s").alias("a"), H.default_label("f", falsy=False).alias("b"),
                     H.default_label("s", H.UNASSIGNED).alias("c")).collect()
    assert [(r.a, r.b, r.c) for r in rows] == [("—", "0", "Unassigned"), ("—", "—", "Unassigned"), ("Evening", "3", "Evening")]


def test_contains_item_under_the_model_collation(spark):
    texts = ["Jollof rice", "2x JÓLLOF", "jo\u0301llof", "yellow rice", "Eßbesteck", "ESSBESTECK", None, ""]
    df = spark.createDataFrame([(x,) for x in texts], "d string")

    def hits(item):
        return [r.d for r in df.where(H.contains_item("d", item)).collect()]

    assert hits("jollof") == hits("JÓLLOF") == texts[:3]
    assert hits("essbe") == hits("Eßbe") == texts[4:6]
    assert hits("ice") == [texts[0], texts[3]]
