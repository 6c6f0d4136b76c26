"""Golden figures from the model's sample rooms and stays (FIXTURES.md section 3).

Only the columns the figures need are stated (no names or phone numbers).
Rooms R101..R130: the type cycles Single, Double, Deluxe, Suite, Executive
Suite; odd rooms are stored Occupied.  Stay n (RES01..RES30) is in room R1nn,
checks in on 2026-(((n-1) % 8) + 1)-n at 14:00, except the three open stays
RES28-RES30 (see below); two more stays share room R102.
"""

import datetime as dt
from decimal import Decimal as D

from innkeep.operators import changes as C, reports, views

from .helpers import make_tables

# --- fixed values: sample room rates R101..R130 ------------------------------
RATES = [
    "275.00", "350.00", "550.00", "775.00", "1225.00", "300.00", "375.00", "500.00", "800.00", "1175.00",
    "250.00", "350.00", "550.00", "800.00", "1225.00", "250.00", "375.00", "500.00", "750.00", "1175.00",
    "250.00", "375.00", "525.00", "725.00", "1225.00", "300.00", "325.00", "525.00", "775.00", "1250.00",
]
# --- fixed values: check-out (month, day) of RES01..RES27, all at 11:00 ----------
CHECK_OUTS = [
    (1, 5), (2, 5), (3, 7), (4, 9), (5, 9), (6, 7), (7, 9), (8, 10), (1, 10), (2, 13),
    (3, 12), (4, 17), (5, 18), (6, 16), (7, 20), (8, 18), (1, 18), (2, 19), (3, 20), (4, 22),
    (5, 22), (6, 23), (7, 26), (8, 25), (2, 2), (2, 28), (4, 2),
]
# --- fixed values: check-in (month, day) of the open stays RES28..RES30 ----------
OPEN_CHECK_INS = [(4, 1), (5, 2), (6, 3)]
# --- end of fixed values ------------------------------------------------------------

TYPES = ["Single", "Double", "Deluxe", "Suite", "Executive Suite"]


def _rows():
    rooms = [
        (f"R{100 + i}", TYPES[(i - 1) % 5], D(RATES[i - 1]), "Occupied" if i % 2 else "Vacant", None)
        for i in range(1, 31)
    ]
    stays = []
    for n in range(1, 31):
        if n <= 27:
            cin = dt.datetime(2026, (n - 1) % 8 + 1, n, 14)
            m, d = CHECK_OUTS[n - 1]
            cout = dt.datetime(2026, m, d, 11)
        else:
            m, d = OPEN_CHECK_INS[n - 28]
            cin, cout = dt.datetime(2026, m, d, 14), None
        stays.append((f"RES{n:02d}", f"R{100 + n}", f"CU{n:02d}", f"FD{(n - 1) % 15 + 1:02d}", cin, cout))
    for rid in ("RES4E", "RESB6"):
        stays.append((rid, "R102", "CU05", "FD01", dt.datetime(2026, 9, 1, 14), dt.datetime(2026, 9, 5, 11)))
    return rooms, stays


def _tables(spark):
    rooms, stays = _rows()
    customers = [(f"CU{n:02d}", f"F{n}", f"L{n}", f"0{n:09d}") for n in range(1, 31)]
    return make_tables(spark, room=rooms, reservation=stays, customer=customers)


def test_room_type_figures(spark):
    T = _tables(spark)
    inv = {r.RoomType: (r.TotalRooms, r.AvgRate, r.OccupiedCount, r.VacantCount)
           for r in reports.room_inventory_report(T).collect()}
    assert inv == {
        "Executive Suite": (6, D("1212.50"), 3, 3), "Suite": (6, D("770.83"), 3, 3),
        "Deluxe": (6, D("525.00"), 3, 3), "Double": (6, D("358.33"), 3, 3), "Single": (6, D("270.83"), 3, 3),
    }
    assert [r.RoomType for r in reports.room_inventory_report(T).collect()][0] == "Executive Suite"
    summary = {r.RoomType: r.AverageRate for r in reports.room_type_summary(T).collect()}
    assert summary["Suite"] == D("770.83")


def test_occupancy_and_listings(spark):
    T = _tables(spark)
    assert reports.occupancy_rate(T).first().OccupiedPct == D("50.00")
    s = reports.occupancy_split(T).first()
    assert (s.occupied_pct, s.vacant_pct) == (50.0, 50.0)
    assert [(r.RoomNo, r.RoomRate) for r in views.vacant_rooms_under(T, D("300.00")).collect()] == [("R116", D("250.00"))]
    assert views.available_rooms(T).count() == 15
    assert views.rooms_above_average(T).count() == 12
    assert sorted((r.ReservationID, r.RoomID) for r in views.active_reservations(T).collect()) == [
        ("RES28", "R128"), ("RES29", "R129"), ("RES30", "R130")]


def test_stay_charges(spark):
    T = _tables(spark)
    closed = T["reservation"].where("CheckOut IS NOT NULL")
    bill = {r.ReservationID: (r.Nights, r.RoomRate, r.Charge) for r in C.stay_bill(closed, T["room"]).collect()}
    want = {"RES01": (4, "275.00", "1237.50"), "RES06": (1, "300.00", "337.50"), "RES17": (1, "375.00", "421.88"),
            "RES20": (2, "1175.00", "2643.75"), "RES23": (3, "525.00", "1771.88"), "RES25": (8, "1225.00", "11025.00"),
            "RES27": (6, "325.00", "2193.75")}
    for k, (n, rate, charge) in want.items():
        assert bill[k] == (n, D(rate), D(charge)), k
    assert len(bill) == 29
    assert sum(v[2] for v in bill.values()) == D("61340.63")


def test_replaying_stay_inserts_sets_room_status(spark):
    T = _tables(spark)
    _, stays = _rows()
    # every stay insert in file order: (RoomID, CheckOut, change_seq)
    feed = spark.createDataFrame([(room, out, i) for i, (_, room, _c, _s, _in, out) in enumerate(stays)],
                                 "RoomID string, CheckOut timestamp_ntz, change_seq long")
    rooms = C.derive_room_status(T["room"], feed)
    occupied = sorted(r.RoomNo for r in rooms.where("RoomStatus = 'Occupied'").collect())
    assert occupied == ["R128", "R129", "R130"]
    assert reports.occupancy_rate({**T, "room": rooms}).first().OccupiedPct == D("10.00")
