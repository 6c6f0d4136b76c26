"""Row-at-a-time models of the change jobs.

Each model applies a random batch one change at a time, in ``change_seq``
order, the way the bookings endpoints do; the set-wise Spark job must give
the same tables and refuse the same changes for the same reasons.
"""

import datetime as dt
import random
from decimal import Decimal as D

from innkeep.operators import changes as C

from .helpers import make_tables

t = dt.datetime


def _reasons(rejects):
    return {r.change_seq: r.reason for r in rejects.collect()}


def test_delete_stays_model(spark):
    rnd = random.Random(21)
    stays = {f"S{i}": (None if rnd.random() < 0.6 else t(2024, 1, 3)) for i in range(30)}
    invoices = {f"I{i}": f"S{rnd.randint(0, 29)}" for i in range(20)}
    feed = [(seq, f"S{rnd.randint(0, 34)}") for seq in rnd.sample(range(1, 400), 45)]
    T = make_tables(
        spark,
        reservation=[(k, "R1", "C1", "F1", t(2024, 1, 1), v) for k, v in stays.items()],
        invoice=[(k, v, "C1", D("1.00"), D("0.00")) for k, v in invoices.items()],
    )
    new, rej = C.delete_stays(T, spark.createDataFrame(feed, "change_seq long, reservation_id string"))

    m_stays, m_inv, refused = dict(stays), dict(invoices), {}
    for seq, rid in sorted(feed):
        if rid not in m_stays:
            refused[seq] = C.NOT_FOUND
        elif m_stays[rid] is not None:
            refused[seq] = C.COMPLETED_DELETE
        else:
            del m_stays[rid]
            m_inv = {k: (None if v == rid else v) for k, v in m_inv.items()}
    assert sorted(r.ReservationID for r in new["reservation"].collect()) == sorted(m_stays)
    assert {r.InvoiceNo: r.ReservationID for r in new["invoice"].collect()} == m_inv
    assert _reasons(rej) == refused


def test_set_room_status_model(spark):
    rnd = random.Random(4)
    rooms = {f"R{i}": rnd.choice(["Occupied", "Vacant"]) for i in range(15)}
    feed = [(seq, f"R{rnd.randint(0, 18)}", rnd.choice(["Occupied", "Vacant", "Vacant", "Dirty"]))
            for seq in rnd.sample(range(1, 300), 60)]
    T = make_tables(spark, room=[(k, "T", D("1.00"), v, None) for k, v in rooms.items()])
    new, rej = C.set_room_status(T, spark.createDataFrame(feed, "change_seq long, room_no string, status string"))

    model, refused = dict(rooms), {}
    for seq, room, status in sorted(feed):
        if status not in ("Occupied", "Vacant"):
            refused[seq] = C.BAD_STATUS
        elif room not in model:
            refused[seq] = C.NOT_FOUND
        else:
            model[room] = status
    assert {r.RoomNo: r.RoomStatus for r in new["room"].collect()} == model
    assert _reasons(rej) == refused


def test_decisions_model(spark):
    rnd = random.Random(8)
    rooms = {"R1", "R2", "R3"}
    desk = {"F1", "F2"}
    statuses = ["Pending"] * 6 + ["Approved", "Declined"]
    requests = {}
    for i in range(25):
        cin = t(2024, 2, 1) + dt.timedelta(days=i)
        cout = cin + dt.timedelta(days=rnd.choice([1, 2, 0]))  # 0: a bad pair
        st = rnd.choice(statuses)
        requests[f"AK-{i}"] = {"cust": f"C{i % 4}", "in": cin, "out": cout, "status": st,
                               "room": "R1" if st == "Approved" else None, "staff": "F1" if st != "Pending" else None}
    approvals, declines = [], []
    for seq in rnd.sample(range(1, 900), 90):
        token = f"AK-{rnd.randint(0, 28)}"
        staff = rnd.choice(["F1", "F2", "F9", None])
        if rnd.random() < 0.5:
            approvals.append((seq, token, rnd.choice(["R1", "R2", "R3", "R7", None]), staff))
        else:
            declines.append((seq, token, staff))
    T = make_tables(
        spark,
        room=[(r, "T", D("1.00"), "Occupied", None) for r in sorted(rooms)],
        frontdesk=[(f, "Morning") for f in sorted(desk)],
        reservation_request=[(k, v["cust"], "T", v["in"], v["out"], v["status"], v["room"], v["staff"], dt.date(2024, 1, 1))
                             for k, v in requests.items()],
    )
    appr = spark.createDataFrame(approvals, "change_seq long, token string, room_no string, staff_id string")
    decl = spark.createDataFrame(declines, "change_seq long, token string, staff_id string")
    new, rej = C.decide_requests(T, appr, decl)

    model = {k: dict(v) for k, v in requests.items()}
    refused, stays = {}, []
    changes = [(s, "approve", tok, room, staff) for s, tok, room, staff in approvals]
    changes += [(s, "decline", tok, None, staff) for s, tok, staff in declines]
    for seq, kind, tok, room, staff in sorted(changes):
        r = model.get(tok)
        if kind == "approve" and not room:
            refused[seq] = "room_no is required"
        elif not staff:
            refused[seq] = "staff_id is required"
        elif r is None:
            refused[seq] = C.NOT_FOUND
        elif r["status"] != "Pending":
            refused[seq] = C.ALREADY + r["status"].lower() + "."
        elif kind == "approve" and room not in rooms:
            refused[seq] = "foreign_key: RoomID"
        elif staff not in desk:
            refused[seq] = "foreign_key: StaffID"
        elif kind == "approve" and r["out"] <= r["in"]:
            refused[seq] = C.STAY_ORDER
        elif kind == "approve":
            r.update(status="Approved", room=room, staff=staff)
            stays.append((room, r["cust"], staff, r["in"], r["out"]))
        else:
            r.update(status="Declined", room=None, staff=staff)
    got = {x.RequestToken: (x.Status, x.RoomNo, x.StaffID) for x in new["reservation_request"].collect()}
    assert got == {k: (v["status"], v["room"], v["staff"]) for k, v in model.items()}
    assert _reasons(rej) == refused
    made = sorted((x.RoomID, x.CustomerID, x.StaffID, x.CheckIn, x.CheckOut) for x in new["reservation"].collect())
    assert made == sorted(stays)


def test_submit_requests_model(spark):
    rnd = random.Random(13)
    customers = {f"CU{i}": ("A", "B", f"05{i % 6}") for i in range(1, 9)}  # some phones shared
    feed = []
    for seq in rnd.sample(range(1, 500), 40):
        phone = rnd.choice([f"05{rnd.randint(0, 7)}", f"09{rnd.randint(0, 3)}"])
        fname = rnd.choice(["Ann", " Bo ", "", "Cy"])
        cin = t(2024, 5, 1) + dt.timedelta(days=rnd.randint(0, 5))
        cout = cin + dt.timedelta(days=rnd.choice([-1, 1, 2]))
        feed.append((seq, fname, "Lee", phone, "Suite", cin, cout))
    T = make_tables(spark, customer=[(k, *v) for k, v in customers.items()])
    df = spark.createDataFrame(
        feed, "change_seq long, fname string, lname string, phone string, room_type string, "
              "check_in timestamp_ntz, check_out timestamp_ntz")
    new, rej = C.submit_requests(T, df, "2024-01-15")

    model_c = {k: v for k, v in customers.items()}
    top = max(int(k[2:]) for k in customers)
    requests, refused = {}, {}
    for seq, fname, lname, phone, rtype, cin, cout in sorted(feed):
        f, l, p = fname.strip(), lname.strip(), phone.strip()
        if not (f and l and p):
            refused[seq] = C.MISSING
            continue
        if cout <= cin:
            refused[seq] = C.REQUEST_ORDER
            continue
        found = sorted(k for k, v in model_c.items() if v[2] == p)
        if found:
            cid = found[0]
        else:
            cid = f"CU{top + seq}"
            model_c[cid] = (f, l, p)
        token = "AK-" + _base36(seq)
        requests[token] = (cid, cin, cout)
    assert {r.CustomerID: (r.CustomerFName, r.CustomerLName, r.PhoneNumber) for r in new["customer"].collect()} == model_c
    got = {r.RequestToken: (r.CustomerID, r.CheckIn, r.CheckOut) for r in new["reservation_request"].collect()}
    assert got == requests
    assert _reasons(rej) == refused


def _base36(n: int) -> str:
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = ""
    while True:
        n, r = divmod(n, 36)
        out = digits[r] + out
        if n == 0:
            return out
