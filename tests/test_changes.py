"""Bulk change jobs (I1-I21) on hand-made tables, plus a row-at-a-time model."""

import datetime as dt
import random
from decimal import Decimal as D

from innkeep.operators import changes as C

from .helpers import make_tables

t = dt.datetime


def _tables(spark):
    return make_tables(
        spark,
        staff=[("HK01", "Ama", "Owusu", "Housekeeping"), ("FD01", "Kofi", "Mensah", "Front Desk"),
               ("FD02", "Esi", "Boateng", "Front Desk")],
        housekeeping=[("HK01", "Morning", 2)],
        frontdesk=[("FD01", "Evening"), ("FD02", "Morning")],
        customer=[("CU01", "Yaw", "Asare", "0241"), ("CU02", "Abena", "Darko", "0242"), ("CU03", "Kwame", "Nk", "0243")],
        room=[("R101", "Single", D("250.00"), "Vacant", "HK01"), ("R102", "Single", D("325.00"), "Occupied", None),
              ("R201", "Suite", D("1200.00"), "Occupied", "HK01")],
        reservation=[("RES1", "R102", "CU01", "FD01", t(2024, 1, 1, 14), None),
                     ("RES2", "R201", "CU02", "FD01", t(2024, 1, 1, 14), None),
                     ("RES3", "R101", "CU01", "FD01", t(2024, 1, 1, 14), t(2024, 1, 2, 10))],
        invoice=[("INV1", "RES2", "CU02", D("1.00"), D("0.50")), ("INV2", "RES3", "CU01", D("50.00"), D("10.00"))],
        customer_feedback=[("FB1", "CU03", 4, "ok", dt.date(2024, 1, 1))],
        reservation_request=[("AK-1", "CU02", "Single", t(2024, 3, 1), t(2024, 3, 2), "Pending", None, None, dt.date(2024, 1, 1)),
                             ("AK-2", "CU01", "Suite", t(2024, 3, 1), t(2024, 3, 2), "Pending", None, None, dt.date(2024, 1, 2))],
    )


def _reasons(rejects, key):
    return {r[key]: r.reason for r in rejects.collect()}


def test_checkout_bills_and_frees_room(spark):
    T = _tables(spark)
    feed = spark.createDataFrame(
        [(1, "RES1", t(2024, 1, 2, 2)), (2, "RES2", t(2024, 1, 3, 14)), (3, "NOPE", None), (4, "RES1", t(2023, 1, 1))],
        "change_seq long, reservation_id string, check_out timestamp_ntz",
    )
    new, rej = C.checkout_and_bill(T, feed, "2024-01-15 12:00:00")
    assert _reasons(rej, "change_seq") == {3: C.NOT_FOUND, 4: C.STAY_ORDER}
    inv = {r.ReservationID: r for r in new["invoice"].collect()}
    # RES1: 12 h exactly -> 1 night at 325 -> 365.62 (half even); a new invoice, nothing paid
    assert inv["RES1"].AmountPayable == D("365.62") and inv["RES1"].AmountPaid == D("0.00")
    assert inv["RES1"].InvoiceNo.startswith("INV")
    # RES2 had an invoice: payable overwritten, paid kept
    assert (inv["RES2"].InvoiceNo, inv["RES2"].AmountPayable, inv["RES2"].AmountPaid) == ("INV1", D("2700.00"), D("0.50"))
    rooms = {r.RoomNo: r.RoomStatus for r in new["room"].collect()}
    assert rooms == {"R101": "Vacant", "R102": "Vacant", "R201": "Vacant"}


def test_delete_stays_keeps_completed_and_nulls_invoice(spark):
    T = _tables(spark)
    feed = spark.createDataFrame([(1, "RES2"), (2, "RES3")], "change_seq long, reservation_id string")
    new, rej = C.delete_stays(T, feed)
    assert _reasons(rej, "change_seq") == {2: C.COMPLETED_DELETE}
    assert sorted(r.ReservationID for r in new["reservation"].collect()) == ["RES1", "RES3"]
    inv = {r.InvoiceNo: r.ReservationID for r in new["invoice"].collect()}
    assert inv == {"INV1": None, "INV2": "RES3"}


def test_two_new_requests_one_phone_make_one_customer(spark):
    T = _tables(spark)
    feed = spark.createDataFrame(
        [(5, " Ann ", "Lee", "0999", "Single", "2024-04-01 14:00:00", "2024-04-02 10:00:00"),
         (6, "Bo", "Lee", "0999", "Suite", "2024-04-01 14:00:00", "2024-04-03 10:00:00"),
         (7, "Cy", "Lee", "0241", "Suite", "2024-04-01", "2024-04-03"),
         (8, "Di", "Lee", "0777", "Suite", "2024-04-05", "2024-04-03"),
         (9, "Ed", "Lee", "0778", "Suite", "next friday", "2024-04-03")],
        "change_seq long, fname string, lname string, phone string, room_type string, check_in string, check_out string",
    )
    new, rej = C.submit_requests(T, feed, "2024-01-15")
    assert _reasons(rej, "change_seq") == {8: C.REQUEST_ORDER, 9: C.INVALID_DATE}
    made = new["customer"].where("PhoneNumber = '0999'").collect()
    assert len(made) == 1 and made[0].CustomerFName == "Ann"
    req = {r.RequestToken: r.CustomerID for r in new["reservation_request"].collect()}
    # AK-1 and AK-2 are in use: made tokens go on above them
    assert req["AK-7"] == req["AK-8"] == made[0].CustomerID
    assert req["AK-9"] == "CU01"
    # a second batch whose numbers start over loses nobody
    again, rej = C.submit_requests({**T, **new}, feed, "2024-01-15")
    assert _reasons(rej, "change_seq") == {8: C.REQUEST_ORDER, 9: C.INVALID_DATE}
    assert again["reservation_request"].select("RequestToken").distinct().count() == again["reservation_request"].count() == len(req) + 3


def test_change_numbers_are_judged_and_ids_stay_unique(spark):
    T = _tables(spark)
    feed = spark.createDataFrame(
        [(1, None, "A"), (1, None, "B"), (None, None, "C"), (-3, None, "D"), (2, None, "E"), (7, "CU50", "F"), (8, None, "G")],
        "change_seq long, customer_id string, fname string",
    ).selectExpr("*", "'L' AS lname", "'0' || fname AS phone")
    new, rej = C.add_customers(T, feed)
    assert {r.fname: r.reason for r in rej.collect()} == {k: C.BAD_SEQ for k in "ABCD"}
    ids = {r.CustomerFName: r.CustomerID for r in new["customer"].collect()}
    assert ids["F"] == "CU50" and ids["E"] == "CU52" and ids["G"] == "CU58"  # above the ids given in the batch
    assert new["customer"].select("CustomerID").distinct().count() == new["customer"].count()


def test_one_unreadable_rating_or_oversized_bill_refuses_itself_alone(spark):
    T = _tables(spark)
    feed = spark.createDataFrame(
        [(1, "CU01", "99999999999", "x"), (2, "CU01", "4", "x"), (3, "CU01", "9" * 40, "x")], "change_seq long, customer_id string, rating string, comments string"
    )
    new, rej = C.add_feedback(T, feed, "2024-01-15")
    assert _reasons(rej, "change_seq") == {1: C.BAD_RATING, 3: C.BAD_RATING}
    numbers = spark.createDataFrame([(1, "CU01", 4.7, "x"), (2, "CU01", 0.0, "x"), (3, "CU01", 1e30, "x")], "change_seq long, customer_id string, rating double, comments string")
    new, rej = C.add_feedback(T, numbers, "2024-01-15")
    assert set(_reasons(rej, "change_seq")) == {2, 3}  # 4.7 is 4
    stays = T["reservation"].where("CheckOut is null").select("ReservationID").collect()
    first = stays[0].ReservationID
    far = spark.createDataFrame([(1, first, "9999-01-01 00:00:00")], "change_seq long, reservation_id string, check_out string")
    tables, rej = C.checkout_and_bill(T, far, "2024-01-15 12:00:00")
    assert _reasons(rej, "change_seq") == {1: "size: AmountPayable"}
    assert tables["invoice"].count() == T["invoice"].count()


def test_first_decision_wins(spark):
    T = _tables(spark)
    appr = spark.createDataFrame([(2, "AK-1", "R101", "FD02"), (3, "AK-2", "R201", "FD01")],
                                 "change_seq long, token string, room_no string, staff_id string")
    decl = spark.createDataFrame([(1, "AK-1", "FD01"), (4, "AK-2", "FD02"), (5, "AK-9", "FD02")],
                                 "change_seq long, token string, staff_id string")
    new, rej = C.decide_requests(T, appr, decl)
    assert _reasons(rej, "change_seq") == {
        2: C.ALREADY + "declined.", 4: C.ALREADY + "approved.", 5: C.NOT_FOUND}
    req = {r.RequestToken: (r.Status, r.RoomNo, r.StaffID) for r in new["reservation_request"].collect()}
    assert req == {"AK-1": ("Declined", None, "FD01"), "AK-2": ("Approved", "R201", "FD01")}
    stay = new["reservation"].where("RoomID = 'R201' AND CustomerID = 'CU01'").collect()
    assert len(stay) == 1 and stay[0].CheckOut == t(2024, 3, 2)
    # the new stay has a check-out, so the trigger leaves the room Vacant
    assert new["room"].where("RoomNo = 'R201'").first().RoomStatus == "Vacant"


def test_booking_sets_occupied_and_checks_keys(spark):
    T = _tables(spark)
    feed = spark.createDataFrame(
        [(1, None, "R101", "CU03", "FD02", t(2024, 5, 1), t(2024, 5, 3)),
         (2, None, "R999", "CU03", "FD02", t(2024, 5, 1), None),
         (3, None, "R101", "CU03", "HK01", t(2024, 5, 1), None),
         (4, "RES1", "R101", "CU03", "FD02", t(2024, 5, 1), None)],
        "change_seq long, reservation_id string, room_id string, customer_id string, staff_id string, "
        "check_in timestamp_ntz, check_out timestamp_ntz",
    )
    new, rej = C.book_stays(T, feed)
    assert _reasons(rej, "change_seq") == {2: "foreign_key: RoomID", 3: "foreign_key: StaffID", 4: C.DUPLICATE}
    assert new["room"].where("RoomNo = 'R101'").first().RoomStatus == "Occupied"
    assert new["reservation"].count() == 4


def test_room_status_last_change_wins_and_set_status(spark):
    T = _tables(spark)
    stays = spark.createDataFrame([("R101", None, 2), ("R101", t(2024, 1, 2), 1), ("R201", t(2024, 1, 2), 7)],
                                  "RoomID string, CheckOut timestamp_ntz, change_seq long")
    rooms = {r.RoomNo: r.RoomStatus for r in C.derive_room_status(T["room"], stays).collect()}
    assert rooms == {"R101": "Occupied", "R102": "Occupied", "R201": "Vacant"}
    feed = spark.createDataFrame([(1, "R101", "Occupied"), (2, "R101", "Cleaning")], "change_seq long, room_no string, status string")
    new, rej = C.set_room_status(T, feed)
    assert _reasons(rej, "change_seq") == {2: C.BAD_STATUS}
    assert new["room"].where("RoomNo = 'R101'").first().RoomStatus == "Occupied"


def test_remove_staff_and_customers(spark):
    T = _tables(spark)
    new, rej = C.remove_staff(T, spark.createDataFrame([(1, "HK01"), (2, "FD01")], "change_seq long, staff_id string"))
    assert _reasons(rej, "change_seq") == {2: C.REFERENCED + "reservation.StaffID"}
    assert new["housekeeping"].count() == 0
    assert {r.HousekeeperID for r in new["room"].collect()} == {None}
    new, rej = C.remove_customers(T, spark.createDataFrame([(1, "CU03"), (2, "CU01")], "change_seq long, customer_id string"))
    assert set(_reasons(rej, "change_seq")) == {2}
    assert new["customer_feedback"].count() == 0


def test_onboard_generates_prefixed_ids(spark):
    T = _tables(spark)
    feed = spark.createDataFrame(
        [(1, None, None, "Kwesi  K Mensah", "Front Desk", "Morning", None), (2, "A", "B", None, "Housekeeping", "Evening", 5)],
        "change_seq long, fname string, lname string, full_name string, role string, shift string, floor int",
    )
    new, rej = C.onboard_staff(T, feed)
    assert rej.count() == 0
    fd = new["staff"].where("StaffFName = 'Kwesi'").first()
    # prefix by role, then the largest number used after it (FD02) + change_seq
    assert fd.StaffLName == "K Mensah" and fd.StaffID == "FD3"
    hk = new["housekeeping"].where("AssignedFloor = 5").collect()
    assert [r.StaffID for r in hk] == ["HK3"]


def test_upsert_last_wins(spark):
    T = _tables(spark)
    ch = spark.createDataFrame([("CU01", "A", "B", "1", 1), ("CU01", "C", "D", "2", 2), ("CU09", "E", "F", "3", 1)],
                               "CustomerID string, CustomerFName string, CustomerLName string, PhoneNumber string, change_seq long")
    out = {r.CustomerID: r.CustomerFName for r in C.upsert(T["customer"], ch, "CustomerID").collect()}
    assert out == {"CU01": "C", "CU02": "Abena", "CU03": "Kwame", "CU09": "E"}


def test_block_room_deletes(spark):
    df = spark.createDataFrame([(1, "R101")], "change_seq long, room_no string")
    assert C.block_room_deletes(df).first().reason == C.ROOM_DELETE


# ------------------------------------------------------------ row-by-row model


def _model_checkout(stays, rooms, invoices, feed, as_of):
    """The model's endpoint applied one change at a time, in change_seq order."""
    stays = {k: dict(v) for k, v in stays.items()}
    rooms = dict(rooms)
    invoices = {k: dict(v) for k, v in invoices.items()}
    next_no = 0
    for seq, rid, out in sorted(feed):
        out = out or as_of
        s = stays.get(rid)
        if s is None or out <= s["in"]:
            continue
        s["out"] = out
        rooms[s["room"]] = "Vacant"
        d = out - s["in"]
        nights = max(1, d.days + (1 if d.seconds > 12 * 3600 else 0))
        charge = D(str(round(nights * float(s["rate"]) * 1.125, 2))).quantize(D("0.01"))
        mine = [k for k, v in invoices.items() if v["res"] == rid]
        if mine:
            for k in mine:
                invoices[k]["pay"] = charge
        else:
            next_no += 1
            invoices[f"new{next_no}"] = {"res": rid, "pay": charge, "paid": D("0.00")}
    return stays, rooms, invoices


def test_checkout_equals_row_by_row_model(spark):
    rnd = random.Random(11)
    rooms = {f"R{i}": ("Occupied" if i % 2 else "Vacant") for i in range(12)}
    rates = {r: D(rnd.randint(5000, 90000)) / 100 for r in rooms}
    base = t(2024, 1, 1)
    stays = {}
    for i in range(40):
        ci = base + dt.timedelta(hours=rnd.randint(0, 500))
        stays[f"S{i}"] = {"room": f"R{rnd.randint(0, 11)}", "in": ci, "out": None}
    invoices = {f"I{i}": {"res": f"S{i}", "pay": D("1.00"), "paid": D("0.25")} for i in range(0, 40, 3)}
    feed = []
    for seq in rnd.sample(range(1, 1000), 80):
        rid = f"S{rnd.randint(0, 45)}"
        out = None if rnd.random() < 0.1 else base + dt.timedelta(hours=rnd.randint(0, 900), minutes=rnd.choice([0, 30]))
        feed.append((seq, rid, out))
    as_of = t(2024, 3, 1, 12)

    T = make_tables(
        spark,
        room=[(r, "T", rates[r], st, None) for r, st in rooms.items()],
        reservation=[(k, v["room"], "CU1", "FD1", v["in"], None) for k, v in stays.items()],
        invoice=[(k, v["res"], "CU1", v["pay"], v["paid"]) for k, v in invoices.items()],
    )
    df = spark.createDataFrame(feed, "change_seq long, reservation_id string, check_out timestamp_ntz")
    new, _ = C.checkout_and_bill(T, df, as_of)

    m_stays, m_rooms, m_inv = _model_checkout(
        {k: {**v, "rate": rates[v["room"]]} for k, v in stays.items()}, rooms, invoices, feed, as_of
    )
    assert {r.ReservationID: r.CheckOut for r in new["reservation"].collect()} == {k: v["out"] for k, v in m_stays.items()}
    assert {r.RoomNo: r.RoomStatus for r in new["room"].collect()} == m_rooms
    got = sorted((r.ReservationID, r.AmountPayable, r.AmountPaid) for r in new["invoice"].collect())
    want = sorted((v["res"], v["pay"], v["paid"]) for v in m_inv.values())
    assert got == want


def test_payments_equal_row_by_row_model(spark):
    rnd = random.Random(5)
    invoices = {f"I{i}": D(rnd.randint(0, 5000)) / 100 for i in range(20)}
    feed = [(seq, f"I{rnd.randint(0, 24)}", D(rnd.randint(-200, 3000)) / 100) for seq in rnd.sample(range(1, 500), 60)]
    T = make_tables(spark, invoice=[(k, None, "CU1", D("100.00"), v) for k, v in invoices.items()])
    df = spark.createDataFrame(feed, "change_seq long, invoice_no string, amount decimal(10,2)")
    new, rej = C.record_payments(T, df)
    model = dict(invoices)
    refused = set()
    for seq, no, amount in sorted(feed):
        if amount <= 0 or no not in model:
            refused.add(seq)
            continue
        model[no] += amount
    assert {r.InvoiceNo: r.AmountPaid for r in new["invoice"].collect()} == model
    assert {r.change_seq for r in rej.collect()} == refused


def test_add_halls_restaurants_orders_events_feedback(spark):
    T = _tables(spark)
    new, rej = C.add_halls(T, spark.createDataFrame([(1, "Main", 100), (2, "", 5), (3, "Side", None)],
                                                    "change_seq long, name string, capacity int"))
    assert _reasons(rej, "change_seq") == {2: C.MISSING, 3: C.MISSING}
    assert [r.HallID for r in new["conference_hall"].collect()] == ["CH1"]
    new, rej = C.add_restaurants(T, spark.createDataFrame([(4, "Grill", 30), (5, "Bar", 0)],
                                                          "change_seq long, name string, seating_capacity int"))
    assert _reasons(rej, "change_seq") == {5: C.MISSING}
    assert [r.RestaurantID for r in new["restaurant"].collect()] == ["RT4"]
    new, rej = C.add_orders(T, spark.createDataFrame(
        [(1, "CU01", "RT9", None, "tea"), (2, "CU01", "RT9", "", "tea")],
        "change_seq long, customer_id string, restaurant_id string, invoice_id string, order_details string"))
    assert _reasons(rej, "change_seq") == {1: "foreign_key: RestaurantID", 2: "foreign_key: RestaurantID"}
    new, rej = C.add_feedback(T, spark.createDataFrame([(1, "CU01", " 5 ", "great"), (2, "CU01", "6", "x"), (3, "CU09", "3", "x")],
                                                       "change_seq long, customer_id string, rating string, comments string"),
                              "2024-01-15")
    assert _reasons(rej, "change_seq") == {2: C.BAD_RATING, 3: "foreign_key: CustomerID"}
    fb = new["customer_feedback"].where("CustomerID = 'CU01'").first()
    assert (fb.Rating, fb.FeedbackDate) == (5, dt.date(2024, 1, 15))


def test_set_amount_paid_last_wins(spark):
    T = _tables(spark)
    feed = spark.createDataFrame([(1, "INV1", D("0.75")), (2, "INV1", D("0")), (3, "INV2", None), (4, "INV9", D("1"))],
                                 "change_seq long, invoice_no string, amount_paid decimal(10,2)")
    new, rej = C.set_amount_paid(T, feed)
    assert _reasons(rej, "change_seq") == {3: "not_null: AmountPaid", 4: C.NOT_FOUND}
    assert {r.InvoiceNo: r.AmountPaid for r in new["invoice"].collect()} == {"INV1": D("0.00"), "INV2": D("10.00")}


def test_checkout_without_check_out_column_uses_as_of(spark):
    T = _tables(spark)
    feed = spark.createDataFrame([(1, "RES1")], "change_seq long, reservation_id string")
    new, rej = C.checkout_and_bill(T, feed, "2024-01-04 10:00:00")
    assert rej.count() == 0
    assert new["reservation"].where("ReservationID = 'RES1'").first().CheckOut == t(2024, 1, 4, 10)


def test_booking_with_unreadable_check_out_is_refused(spark):
    T = _tables(spark)
    feed = spark.createDataFrame([(1, "R101", "CU03", "FD02", "2024-05-01 14:00:00", "later"),
                                  (2, "R101", "CU03", "FD02", "2024-05-01T14:00:00", "")],
                                 "change_seq long, room_id string, customer_id string, staff_id string, "
                                 "check_in string, check_out string")
    new, rej = C.book_stays(T, feed)
    assert _reasons(rej, "change_seq") == {1: C.INVALID_DATE}
    booked = new["reservation"].where("CustomerID = 'CU03'").collect()
    assert len(booked) == 1 and booked[0].CheckOut is None and booked[0].CheckIn == t(2024, 5, 1, 14)


def test_lookup_against_a_parent_with_a_repeated_key(spark):
    T = _tables(spark)
    # a dirty room table: R101 twice
    T["room"] = T["room"].unionByName(T["room"].where("RoomNo = 'R101'"))
    feed = spark.createDataFrame([(1, None, "R101", "CU03", "FD02", t(2024, 5, 1), None)],
                                 "change_seq long, reservation_id string, room_id string, customer_id string, "
                                 "staff_id string, check_in timestamp_ntz, check_out timestamp_ntz")
    new, rej = C.book_stays(T, feed)
    assert rej.count() == 0
    assert new["reservation"].where("CustomerID = 'CU03'").count() == 1


FAR = 2**63 - 1


def test_an_extreme_id_is_refused_alone(spark):
    """Numeric ids: the normal rows of the batch, and of the next one, get theirs."""
    tables = {**make_tables(spark), "customer": spark.createDataFrame([(7, "A", "B", "1"), (FAR, "Old", "One", "2")], "CustomerID long, CustomerFName string, CustomerLName string, PhoneNumber string")}
    feed = spark.createDataFrame([(1, FAR, "x", "y", "3"), (2, 10**15, "x", "y", "3"), (3, None, "x", "y", "4"), (4, 9, "x", "y", "5"), (10**15, None, "x", "y", "6")], "change_seq long, customer_id long, fname string, lname string, phone string")
    for after in (9, 12):
        new, rejects = C.add_customers(tables, feed)
        got = {(r.change_seq, r.reason) for r in rejects.collect()}
        assert got >= {(1, "size: CustomerID"), (2, "size: CustomerID"), (10**15, C.BAD_SEQ)} and len(got) == 3 + (after > 9)
        tables = {**tables, **new}
        assert after + 3 in {r.CustomerID for r in new["customer"].collect()}


def test_an_extreme_text_id_is_refused_alone(spark):
    long = "CU" + "9" * 38
    tables = make_tables(spark, customer=[("CU7", "A", "B", "1"), (long, "Old", "One", "2")])
    feed = spark.createDataFrame([(1, long + "9", "x", "y", "3"), (2, "CU1000000000000000", "x", "y", "3"), (3, None, "x", "y", "4"), (4, "CU007", "x", "y", "5"), (5, "Z1", "x", "y", "6")], "change_seq long, customer_id string, fname string, lname string, phone string")
    new, rejects = C.add_customers(tables, feed)
    assert {(r.change_seq, r.reason) for r in rejects.collect()} == {(1, "size: CustomerID"), (2, "size: CustomerID")}
    assert {r.CustomerID for r in new["customer"].collect()} == {"CU7", long, "CU10", "CU007", "Z1"}


def test_a_given_token_blocks_no_later_batch(spark):
    feed = "change_seq long, fname string, lname string, phone string, room_type string, check_in string, check_out string, token string"
    row = ("A", "B", "1", "S", "2024-01-01 10:00:00", "2024-01-02 10:00:00")
    tables = make_tables(spark)
    for batch in range(3):
        changes = spark.createDataFrame([(1, *row, "AK-ZZZZZZZZZZZZ"), (2, *row, None), (3, *row, "AK-" + "Z" * 30), (4, *row, f"mine{batch}"), (5, *row, "AK-1Z")], feed)
        new, rejects = C.submit_requests(tables, changes, "2024-01-01")
        got = {(r.change_seq, r.reason) for r in rejects.collect()}
        assert got == {(1, "size: RequestToken"), (3, "size: RequestToken")} | ({(5, "duplicate key")} if batch else set())
        tables = {**tables, **new}
    tokens = {r.RequestToken for r in tables["reservation_request"].collect()}
    assert tokens == {"AK-1Z", "mine0", "mine1", "mine2", "AK-21", "AK-23", "AK-25"}


def test_made_ids_are_not_looked_up_and_given_ones_only_in_their_range(spark, tmp_path):
    rows = spark.range(0, 40000, 1, 8).selectExpr("id AS CustomerID", "'A' AS CustomerFName", "'B' AS CustomerLName", "'1' AS PhoneNumber")
    rows.write.parquet(str(tmp_path / "customer"))
    base = spark.read.parquet(str(tmp_path / "customer"))
    tables = {**make_tables(spark), "customer": base}
    made = spark.createDataFrame([(1, "x", "y", "3")], "change_seq long, fname string, lname string, phone string")
    plan = C.append_validated(tables, "customer", made, {"CustomerFName": C.F.col("fname"), "CustomerLName": C.F.col("lname"), "PhoneNumber": C.F.col("phone")}, (), "customer_id")[2]
    assert plan.count() == 0
    given = spark.createDataFrame([(1, 17, "x", "y", "3"), (2, 41000, "x", "y", "3"), (3, 30000, "x", "y", "3")], "change_seq long, customer_id long, fname string, lname string, phone string")
    assert {(r.change_seq, r.reason) for r in C.add_customers(tables, given)[1].collect()} == {(1, "duplicate key"), (3, "duplicate key")}
    # the bounds reach the scan: row groups outside are not read
    some = C._between(base, "CustomerID", spark.createDataFrame([(17,), (40,)], "id long"), C.F.col("id"))
    assert {r.CustomerID for r in some.collect()} == set(range(17, 41))
    assert scanned(some._jdf.queryExecution().executedPlan().finalPhysicalPlan()) < 40000 / 4


def test_a_change_numbered_zero_gets_no_id_in_use(spark):
    feed = spark.createDataFrame([(0, "x", "y", "3"), (2, "x", "y", "4")], "change_seq long, fname string, lname string, phone string")
    for first, want in (("CU7", {"CU7", "CU9"}), ("CU007", {"CU007", "CU7", "CU9"})):
        new, rejects = C.add_customers(make_tables(spark, customer=[(first, "A", "B", "1")]), feed)
        assert {r.CustomerID for r in new["customer"].collect()} == want
        assert [r.reason for r in rejects.collect()] == ["duplicate key"] * (3 - len(want))
    row = ("A", "B", "1", "S", "2024-01-01 10:00:00", "2024-01-02 10:00:00")
    requests = spark.createDataFrame([(0, *row), (3, *row)], "change_seq long, fname string, lname string, phone string, room_type string, check_in string, check_out string")
    tables = make_tables(spark)
    for tokens, refused in (({"AK-0", "AK-3"}, 0), ({"AK-0", "AK-3", "AK-6"}, 1)):
        new, rejects = C.submit_requests(tables, requests, "2024-01-01")
        tables = {**tables, **new}
        assert {r.RequestToken for r in new["reservation_request"].collect()} == tokens and rejects.count() == refused


def scanned(plan):
    """Rows that the scans of a plan that has run gave out."""
    rows = plan.metrics().get("numOutputRows").get().value() if plan.nodeName().startswith("Scan parquet") else 0
    children = plan.children()
    return rows + sum(scanned(children.apply(i)) for i in range(children.size()))
