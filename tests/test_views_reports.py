"""Listings, joins and reports (B, C, D) on hand-made edge cases."""

import datetime as dt
from decimal import Decimal as D

from innkeep.operators import reports, views

from .helpers import make_tables

t = dt.datetime


def _tables(spark):
    return make_tables(
        spark,
        staff=[("HK01", "Ama", "Owusu", "Housekeeping"), ("FD01", "Kofi", "Mensah", "Front Desk"),
               ("FD02", "Esi", "Boateng", "Front Desk")],
        housekeeping=[("HK01", "Morning", 2)],
        frontdesk=[("FD01", "Evening"), ("FD02", "Morning")],
        customer=[("CU01", "Yaw", "Asare", "0241"), ("CU02", "Abena", "Darko", "0242"),
                  ("CU03", "Kwame", None if False else "Nkrumah", "0241")],
        conference_hall=[("CH01", "Volta", 100), ("CH02", "Volta", 80), ("CH03", "Ashanti", 50)],
        restaurant=[("RT01", "Main", 40)],
        room=[("R101", "Single", D("250.00"), "Vacant", "HK01"), ("R102", "Single", D("300.00"), "Occupied", None),
              ("R201", "Suite", D("1200.00"), "Occupied", "HK01"), ("R202", "Suite", D("325.00"), "Vacant", None)],
        reservation=[("RES1", "R102", "CU01", "FD01", t(2024, 1, 1, 14), None),
                     ("RES2", "R102", "CU02", "FD01", t(2024, 1, 2, 14), None),
                     ("RES3", "R201", "CU01", "FD01", t(2024, 1, 1, 14), t(2024, 1, 2, 2))],
        event=[("EV1", "Wedding", dt.date(2024, 2, 1), D("2.5"), "CU01", "CH01"),
               ("EV2", "Seminar", dt.date(2023, 2, 1), D("1.0"), "CU02", "CH02")],
        invoice=[("INV1", "RES3", "CU01", D("100.00"), D("40.00")), ("INV2", None, "CU02", D("50.00"), D("50.00"))],
        restaurant_order=[("RO1", "CU01", "RT01", None, "2x JOLLOF rice"), ("RO2", "CU02", "RT01", "INV2", "tea")],
        reservation_request=[("AK-1", "CU02", "Single", t(2024, 3, 1), t(2024, 3, 2), "Pending", None, None, dt.date(2024, 1, 1)),
                             ("AK-2", "CU01", "Double", t(2024, 3, 1), t(2024, 3, 2), "Pending", None, None, dt.date(2024, 1, 2)),
                             ("AK-3", "CU01", "Single", t(2024, 3, 1), t(2024, 3, 2), "Approved", "R101", "FD01", dt.date(2024, 1, 3))],
    )


def test_room_with_two_open_stays_has_two_rows(spark):
    T = _tables(spark)
    rows = views.room_occupancy(T).where("RoomNo = 'R102'").collect()
    assert sorted(r.ReservationID for r in rows) == ["RES1", "RES2"]
    vacant = views.room_occupancy(T).where("RoomNo = 'R101'").collect()
    assert len(vacant) == 1 and vacant[0].ReservationID is None


def test_hall_without_events_sorted_last_with_null_hours(spark):
    rows = reports.hall_utilisation(_tables(spark)).collect()
    assert rows[-1].HallID == "CH03" and rows[-1].EventsHosted == 0 and rows[-1].TotalHoursBooked is None


def test_same_named_halls_merge(spark):
    rows = reports.hall_hours_over(_tables(spark), D("2.0")).collect()
    assert [(r.HallName, r.TotalHoursBooked) for r in rows] == [("Volta", D("3.5"))]


def test_zero_rooms_occupancy(spark):
    T = make_tables(spark)
    assert reports.occupancy_rate(T).first().OccupiedPct == D("0.00")
    r = reports.occupancy_split(T).first()
    assert (r.occupied_pct, r.vacant_pct) == (0.0, 100.0)


def test_inventory_and_dashboard(spark):
    T = _tables(spark)
    inv = {r.RoomType: r for r in reports.room_inventory_report(T).collect()}
    assert inv["Suite"].AvgRate == D("762.50") and inv["Suite"].OccupiedCount == 1
    d = reports.dashboard_stats(T, "2024-01-15").first()
    assert (d.unoccupied_rooms, d.occupied_rooms, d.occupancy_rate, d.upcoming_events_count) == (2, 2, 50.0, 1)


def test_frontdesk_workload_counts_zero(spark):
    rows = {r.StaffID: r.ReservationsHandled for r in reports.frontdesk_workload(_tables(spark)).collect()}
    assert rows == {"FD01": 3, "FD02": 0}


def test_customers_ordering_is_case_insensitive(spark):
    rows = views.customers_ordering(_tables(spark), "jollof").collect()
    assert [r.CustomerID for r in rows] == ["CU01"]


def test_request_list_order_and_matches(spark):
    T = _tables(spark)
    assert [r.RequestToken for r in views.request_list(T).collect()] == ["AK-2", "AK-1", "AK-3"]
    m = {r.RequestToken: r for r in views.request_room_matches(T).collect()}
    assert m["AK-1"].RoomNo == "R101" and m["AK-1"].MatchingRooms == 1
    assert m["AK-2"].RoomNo is None and m["AK-2"].MatchingRooms == 0


def test_rooms_above_average_and_outstanding(spark):
    T = _tables(spark)
    assert [r.RoomNo for r in views.rooms_above_average(T).collect()] == ["R201"]
    out = views.outstanding_invoices(T).collect()
    assert [(r.InvoiceNo, r.BalanceDue) for r in out] == [("INV1", D("60.00"))]


def test_customer_reservations_by_ids(spark):
    T = _tables(spark)
    rows = views.customer_reservations(T, ["CU01"]).collect()
    assert sorted(r.ReservationID for r in rows) == ["RES1", "RES3"]


def test_request_status_by_typed_token(spark):
    T = _tables(spark)
    tokens = spark.createDataFrame([(" ak-1 ",)], "t string")
    rows = views.request_status(T, tokens).collect()
    assert [r.RequestToken for r in rows] == ["AK-1"]
