"""Derive the bookings tables from the driver's star-schema tables.

Every hotel table is a lazy projection (or one equi-join) of a driver table,
so Catalyst prunes columns and tables that a query does not use, and the
work grows with the input.  Identifiers stay ``bigint``.

The three table sizes the mapping depends on (``np`` parts, ``nc``
customers, ``h`` = half the suppliers) are passed in as numbers when the
caller has counted the tables (:func:`innkeep.sources.tables.load_tables`
does, once per session and directory: a footer-only count per table).
Without them they are scalar subqueries; Spark does not reuse those across
the many references of one plan, so the counted form is the default.

The same mapping is written in DuckDB SQL in :mod:`innkeep.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .schema import EVENT_TYPES, HOURS, MONEY, SHIFTS

# fixed values: driver event types in sorted order, paired with EVENT_TYPES
DRIVER_EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
EVENTS_AS_OF = "2024-01-15"
FEEDBACK_EPOCH = "2026-01-01"


def _count(df: DataFrame) -> Column:
    return df.select(F.count(F.lit(1))).scalar()


def _shift(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SHIFTS]), (key % 3 + 1).cast("int"))


def _hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def _days_hours(days: Column, hours: Column) -> Column:
    return F.make_dt_interval(days.cast("int"), hours.cast("int"))


def _stay_window(o: DataFrame):
    k = F.col("o_orderkey")
    check_in = F.col("o_orderdate") + _hours(F.lit(14))
    check_out = F.col("o_orderdate") + _days_hours(1 + k % 7, k % 24)
    return check_in, check_out


def hotel_tables(raw: dict[str, DataFrame], sizes: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """Map the driver tables (by name) to the 13 bookings tables.

    ``sizes``: row counts of ``part``, ``customer`` and ``supplier`` if known.
    """
    supplier, customer, part, orders = raw["supplier"], raw["customer"], raw["part"], raw["orders"]
    if sizes:
        n_parts = F.lit(sizes["part"]).cast("bigint")
        n_customers = F.lit(sizes["customer"]).cast("bigint")
        half_suppliers = F.lit(sizes["supplier"] // 2).cast("bigint")
    else:
        n_parts = _count(part)
        n_customers = _count(customer)
        half_suppliers = F.floor(_count(supplier) / 2).cast("bigint")

    sk = F.col("s_suppkey")
    staff = supplier.select(
        sk.alias("StaffID"),
        F.lit("Supplier").alias("StaffFName"),
        F.substr("s_name", F.lit(10)).alias("StaffLName"),
        F.when(sk % 2 == 0, "Front Desk").otherwise("Housekeeping").alias("StaffRole"),
    )
    frontdesk = supplier.where(sk % 2 == 0).select(sk.alias("StaffID"), _shift(sk).alias("Shift"))
    housekeeping = supplier.where(sk % 2 == 1).select(
        sk.alias("StaffID"), _shift(sk).alias("Shift"), (sk % 21).cast("int").alias("AssignedFloor")
    )

    ck = F.col("c_custkey")
    phone_key = ck - F.when(ck % 50 == 1, 1).otherwise(0)
    hotel_customer = customer.select(
        ck.alias("CustomerID"),
        F.col("c_mktsegment").alias("CustomerFName"),
        F.substr("c_name", F.lit(10)).alias("CustomerLName"),
        F.concat(F.lit("0"), F.lpad(phone_key.cast("string"), 9, "0")).alias("PhoneNumber"),
    )

    nk = F.col("n_nationkey").cast("bigint")
    conference_hall = raw["nation"].select(
        nk.alias("HallID"),
        F.concat(F.lit("HALL_"), (nk % 20).cast("string")).alias("HallName"),
        (50 + 10 * nk).cast("int").alias("Capacity"),
    )

    rk = F.col("r_regionkey").cast("bigint")
    restaurant = raw["region"].select(
        rk.alias("RestaurantID"),
        F.col("r_name").alias("RestaurantName"),
        (40 + 20 * rk).cast("int").alias("SeatingCapacity"),
    )

    pk = F.col("p_partkey")
    room = part.select(
        pk.alias("RoomNo"),
        F.col("p_type").alias("RoomType"),
        F.col("p_retailprice").cast(MONEY).alias("RoomRate"),
        F.when(F.col("p_size") % 2 == 0, "Occupied").otherwise("Vacant").alias("RoomStatus"),
        F.when(pk % 10 == 0, F.lit(None).cast("bigint"))
        .otherwise(2 * (pk % half_suppliers) + 1)
        .alias("HousekeeperID"),
    )

    ok, oc = F.col("o_orderkey"), F.col("o_custkey")
    check_in, check_out = _stay_window(orders)
    front_desk_of = 2 * (ok % (half_suppliers - 1))
    reservation = orders.select(
        ok.alias("ReservationID"),
        ((7 * ok + 13 * oc) % n_parts).alias("RoomID"),
        oc.alias("CustomerID"),
        front_desk_of.alias("StaffID"),
        check_in.alias("CheckIn"),
        F.when((F.col("o_orderstatus") == "O") & (ok % 10 == 0), F.lit(None))
        .otherwise(check_out)
        .alias("CheckOut"),
    )

    ek = F.col("event_id")
    type_map = F.create_map(*[x for pair in zip(DRIVER_EVENT_TYPES, EVENT_TYPES) for x in map(F.lit, pair)])
    event = raw["events"].select(
        ek.alias("EventID"),
        type_map[F.col("event_type")].alias("EventType"),
        F.to_date("ts").alias("EventDate"),
        ((ek % 16 + 1) * F.lit(0.5).cast("decimal(2,1)")).cast(HOURS).alias("EventDuration"),
        F.col("user_id").alias("Host"),
        (ek % 24).alias("HallID"),
    )

    payable = F.col("o_totalprice").cast(MONEY)
    invoice = orders.where(ok % 4 != 0).select(
        ok.alias("InvoiceNo"),
        F.when(ok % 9 == 0, F.lit(None).cast("bigint")).otherwise(ok).alias("ReservationID"),
        oc.alias("CustomerID"),
        payable.alias("AmountPayable"),
        F.when(F.col("o_orderstatus") == "F", payable)
        .when(F.col("o_orderstatus") == "P", F.floor(payable).cast(MONEY))
        .otherwise(F.lit(0).cast(MONEY))
        .alias("AmountPaid"),
    )

    orders_part = orders.join(part.select("p_partkey", "p_name", "p_type"), (ok % n_parts) == pk)
    restaurant_order = orders_part.select(
        ok.alias("OrderID"),
        oc.alias("CustomerID"),
        (ok % 5).alias("RestaurantID"),
        F.when(ok % 2 == 0, F.lit(None).cast("bigint")).otherwise(ok).alias("InvoiceID"),
        F.concat((1 + ok % 4).cast("string"), F.lit("x "), F.col("p_name")).alias("OrderDetails"),
    )

    dk = F.col("doc_id")
    customer_feedback = raw["documents"].select(
        dk.alias("FeedbackID"),
        (dk % n_customers).alias("CustomerID"),
        (F.col("n_chars") % 6).cast("int").alias("Rating"),
        F.col("text").alias("Comments"),
        F.date_add(F.lit(FEEDBACK_EPOCH).cast("date"), (dk % 365).cast("int")).alias("FeedbackDate"),
    )

    status = (
        F.when(F.col("o_orderstatus") == "O", "Pending")
        .when(F.col("o_orderstatus") == "F", "Approved")
        .when(F.col("o_orderstatus") == "P", "Declined")
    )
    approved = F.col("o_orderstatus") == "F"
    reservation_request = orders_part.where(ok % 5 == 0).select(
        F.concat(F.lit("RQ-"), ok.cast("string")).alias("RequestToken"),
        oc.alias("CustomerID"),
        F.col("p_type").alias("RoomType"),
        check_in.alias("CheckIn"),
        check_out.alias("CheckOut"),
        status.alias("Status"),
        F.when(approved, pk).alias("RoomNo"),
        F.when(approved, front_desk_of).alias("StaffID"),
        F.to_date("o_orderdate").alias("RequestDate"),
    )

    return {
        "staff": staff,
        "housekeeping": housekeeping,
        "frontdesk": frontdesk,
        "customer": hotel_customer,
        "conference_hall": conference_hall,
        "restaurant": restaurant,
        "room": room,
        "reservation": reservation,
        "event": event,
        "invoice": invoice,
        "restaurant_order": restaurant_order,
        "customer_feedback": customer_feedback,
        "reservation_request": reservation_request,
    }
