"""The listings in sequence: the stated sort with the key as tie-break, against the oracle sorted the same way."""

import os

import pytest

from innkeep.plans import catalog

from .conftest import SF_SMALL

ORDER = {
    "customer_directory": "CustomerID",
    "vacant_rooms_under": "RoomNo",
    "available_rooms": "RoomType, RoomRate, RoomNo",
    "housekeepers": "StaffID",
    "halls": "HallID",
    "restaurants": "RestaurantID",
    "invoices": "InvoiceNo",
    "rooms_with_housekeeper": "RoomNo",
    "active_reservations": "ReservationID",
    "outstanding_invoices": "BalanceDue DESC, InvoiceNo",
    "staff_directory": "StaffID",
    "upcoming_events": "EventDate, EventID",
    "reservation_list": "CheckIn DESC, ReservationID",
    "event_list": "EventDate, EventID",
    "order_list": "OrderID",
    "feedback_list": "FeedbackDate DESC, FeedbackID",
    "request_list": "list_position(['Pending', 'Approved', 'Declined'], Status), RequestDate DESC, RequestToken",
    "customers_ordering": "CustomerID",
    "rooms_above_average": "RoomNo",
    "room_inventory_report": "AvgRate DESC, RoomType",
    "frontdesk_workload": "ReservationsHandled DESC, StaffID",
    "hall_utilisation": "TotalHoursBooked DESC NULLS LAST, HallID",
}


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver test data not present")
@pytest.mark.parametrize("name", ORDER)
def test_listing_in_sequence(spark, name):
    from tools.compare import duck

    df = catalog.build(name, spark, SF_SMALL)
    columns = ", ".join(f'CAST("{c}" AS VARCHAR)' for c in df.columns)
    con = duck(SF_SMALL)
    keys = [c for c in df.columns if c in ORDER[name]]
    want = con.execute(f"SELECT {columns} FROM ({catalog.oracle_sql(name)}) ORDER BY {ORDER[name]}").fetchall()
    at = [df.columns.index(c) for c in keys]
    got = [tuple(str(r[c]) for c in keys) for r in df.collect()]
    assert got == [tuple(str(r[i]) for i in at) for r in want]
