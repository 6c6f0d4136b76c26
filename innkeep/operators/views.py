"""Listings and views: projections, filters and joins.

Every function takes the dict of bookings tables ``T`` (see
:func:`innkeep.sources.tables.load_tables`) and returns a lazy DataFrame.
``ordered=True`` applies the listing's sort order (with the primary key as
tie-breaker, so the order is total); pass ``ordered=False`` when the result
feeds another job or a writer and the global sort would be wasted work.

Join strategy is left to Catalyst and AQE: dimension sides that are small at
run time are broadcast by Spark's own size check
(``spark.sql.adaptive.autoBroadcastJoinThreshold``), everything else is a
sort-merge join with AQE skew splitting.  Nothing here forces a broadcast.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import contains_item, full_name, normalise_token, status_rank

Tables = dict[str, DataFrame]


def _sort(df: DataFrame, ordered: bool, *cols) -> DataFrame:
    return df.orderBy(*cols) if ordered else df


def _ids_frame(ids, column: str, like: DataFrame) -> DataFrame:
    """Accept a one-column DataFrame or a Python list of keys."""
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).alias(column))
    spark = like.sparkSession
    dtype = like.schema[column].dataType
    return spark.createDataFrame([(i,) for i in ids], f"{column} {dtype.simpleString()}")


# ---------------------------------------------------------------- B: listings


def customer_directory(T: Tables, ordered: bool = True) -> DataFrame:
    """B1."""
    df = T["customer"].select("CustomerID", "CustomerFName", "CustomerLName", "PhoneNumber")
    return _sort(df, ordered, "CustomerID")


def vacant_rooms_under(T: Tables, cap=Decimal("300.00"), ordered: bool = False) -> DataFrame:
    """B2: vacant rooms with a rate strictly under ``cap``."""
    r = T["room"]
    df = r.where((F.col("RoomStatus") == "Vacant") & (F.col("RoomRate") < F.lit(cap))).select(
        "RoomNo", "RoomType", "RoomRate"
    )
    return _sort(df, ordered, "RoomNo")


def available_rooms(T: Tables, ordered: bool = True) -> DataFrame:
    """Vacant rooms by type and rate (stored status, as the model does)."""
    df = T["room"].where(F.col("RoomStatus") == "Vacant").select("RoomNo", "RoomType", "RoomRate")
    return _sort(df, ordered, "RoomType", "RoomRate", "RoomNo")


def housekeepers(T: Tables, ordered: bool = True) -> DataFrame:
    """B4."""
    df = T["staff"].where(F.col("StaffRole") == "Housekeeping").select(
        "StaffID", "StaffFName", "StaffLName", "StaffRole"
    )
    return _sort(df, ordered, "StaffID")


def halls(T: Tables, ordered: bool = True) -> DataFrame:
    """B5."""
    return _sort(T["conference_hall"].select("HallID", "HallName", "Capacity"), ordered, "HallID")


def restaurants(T: Tables, ordered: bool = True) -> DataFrame:
    """B6."""
    df = T["restaurant"].select("RestaurantID", "RestaurantName", "SeatingCapacity")
    return _sort(df, ordered, "RestaurantID")


def invoices(T: Tables, ordered: bool = True) -> DataFrame:
    """B7."""
    df = T["invoice"].select("InvoiceNo", "ReservationID", "CustomerID", "AmountPayable", "AmountPaid")
    return _sort(df, ordered, "InvoiceNo")


def public_rooms(T: Tables) -> DataFrame:
    """B3 for guests; no order requested."""
    return available_rooms(T, ordered=False)


def public_events(T: Tables, as_of, ordered: bool = True) -> DataFrame:
    """Guest projection of C6."""
    return upcoming_events(T, as_of, ordered=ordered).select(
        "EventType", "EventDate", "EventDuration", "HallName", "Capacity"
    )


def customer_reservations(T: Tables, ids, ordered: bool = False) -> DataFrame:
    """Stays of one customer id, or of a set of ids (list or DataFrame).

    A set is a left-semi join, so each stay appears once however many times
    its customer is listed.
    """
    r = T["reservation"]
    if isinstance(ids, (str, int)):
        df = r.where(F.col("CustomerID") == F.lit(ids))
    else:
        df = r.join(_ids_frame(ids, "CustomerID", r).distinct(), "CustomerID", "left_semi")
    df = df.select("ReservationID", "RoomID", "CheckIn", "CheckOut")
    return _sort(df, ordered, "ReservationID")


# ------------------------------------------------------------------- C: joins


def _names(T: Tables, key: str, alias: str, table: str = "customer") -> DataFrame:
    if table == "customer":
        c = T["customer"]
        return c.select(F.col("CustomerID").alias(key), full_name("CustomerFName", "CustomerLName").alias(alias))
    s = T["staff"]
    return s.select(F.col("StaffID").alias(key), full_name("StaffFName", "StaffLName").alias(alias))


def rooms_with_housekeeper(T: Tables, ordered: bool = True) -> DataFrame:
    """Every room, with its housekeeper's name (NULL when unassigned)."""
    df = T["room"].join(_names(T, "HousekeeperID", "HousekeeperName", "staff"), "HousekeeperID", "left")
    df = df.select("RoomNo", "RoomType", "RoomRate", "RoomStatus", "HousekeeperID", "HousekeeperName")
    return _sort(df, ordered, "RoomNo")


def active_reservations(T: Tables, ordered: bool = False) -> DataFrame:
    """Open stays with the guest's name."""
    open_stays = T["reservation"].where(F.col("CheckOut").isNull())
    df = open_stays.join(_names(T, "CustomerID", "GuestName"), "CustomerID").select(
        "ReservationID", "RoomID", "GuestName", "CheckIn", "CheckOut"
    )
    return _sort(df, ordered, "ReservationID")


def room_occupancy(T: Tables, ordered: bool = False) -> DataFrame:
    """Every room with its open stay(s) and guest, if any.

    The open-stay predicate belongs to the outer join's ON clause, so it is
    applied to the stays *before* the join: vacant rooms keep one row, a
    room with two open stays gets two.

    Written as (open stays INNER JOIN rooms) UNION (rooms without an open
    stay) rather than ``rooms LEFT JOIN stays``: a room holding a large share
    of the open stays is then on the side of an inner join that AQE can split
    into several tasks (the right side of a left outer join cannot be split),
    and the anti join reads only the distinct rooms that have stays.
    """
    open_stays = T["reservation"].where(F.col("CheckOut").isNull()).select(
        F.col("RoomID").alias("RoomNo"), "ReservationID", "CustomerID", "CheckIn", "CheckOut"
    )
    guests = _names(T, "CustomerID", "GuestName")
    stays = open_stays.join(guests, "CustomerID", "left")
    rooms = T["room"].select("RoomNo", "RoomType", "RoomRate", "RoomStatus")
    cols = ["RoomNo", "RoomType", "RoomRate", "RoomStatus", "ReservationID", "CustomerID", "GuestName", "CheckIn", "CheckOut"]
    occupied = stays.join(rooms, "RoomNo").select(*cols)
    empty = rooms.join(open_stays.select("RoomNo").distinct(), "RoomNo", "left_anti").select(
        *[
            F.col(c) if c in rooms.columns else F.lit(None).cast(occupied.schema[c].dataType).alias(c)
            for c in cols
        ]
    )
    df = occupied.unionByName(empty)
    return _sort(df, ordered, "RoomNo", "ReservationID")


def outstanding_invoices(T: Tables, ordered: bool = True) -> DataFrame:
    """C4: invoices with a balance, largest balance first."""
    inv = T["invoice"].where(F.col("AmountPaid") < F.col("AmountPayable"))
    df = inv.join(_names(T, "CustomerID", "CustomerName"), "CustomerID").select(
        "InvoiceNo",
        "CustomerID",
        "CustomerName",
        "ReservationID",
        "AmountPayable",
        "AmountPaid",
        (F.col("AmountPayable") - F.col("AmountPaid")).alias("BalanceDue"),
    )
    return _sort(df, ordered, F.col("BalanceDue").desc(), "InvoiceNo")


def staff_directory(T: Tables, ordered: bool = True) -> DataFrame:
    """Staff with their subtype's shift and floor."""
    hk = T["housekeeping"].select("StaffID", F.col("Shift").alias("hk_shift"), "AssignedFloor")
    fd = T["frontdesk"].select("StaffID", F.col("Shift").alias("fd_shift"))
    df = (
        T["staff"]
        .join(hk, "StaffID", "left")
        .join(fd, "StaffID", "left")
        .select(
            "StaffID",
            full_name("StaffFName", "StaffLName").alias("StaffName"),
            "StaffRole",
            F.coalesce("hk_shift", "fd_shift").alias("Shift"),
            "AssignedFloor",
        )
    )
    return _sort(df, ordered, "StaffID")


def _events_with_hall_and_host(T: Tables) -> DataFrame:
    hall = T["conference_hall"].select("HallID", "HallName", "Capacity")
    host = _names(T, "Host", "HostName")
    return T["event"].join(hall, "HallID").join(host, "Host")


def upcoming_events(T: Tables, as_of, ordered: bool = True) -> DataFrame:
    """Events on or after ``as_of`` with hall and host."""
    ev = T["event"].where(F.col("EventDate") >= F.lit(as_of).cast("date"))
    hall = T["conference_hall"].select("HallID", "HallName", "Capacity")
    df = ev.join(hall, "HallID").join(_names(T, "Host", "HostName"), "Host").select(
        "EventID",
        "EventType",
        "EventDate",
        "EventDuration",
        "HallID",
        "HallName",
        "Capacity",
        F.col("Host").alias("HostID"),
        "HostName",
    )
    return _sort(df, ordered, "EventDate", "EventID")


def reservation_list(T: Tables, ordered: bool = True) -> DataFrame:
    """All stays with the customer's name, latest check-in first."""
    df = T["reservation"].join(_names(T, "CustomerID", "CustomerName"), "CustomerID").select(
        "ReservationID", "RoomID", "CustomerID", "CustomerName", "StaffID", "CheckIn", "CheckOut"
    )
    return _sort(df, ordered, F.col("CheckIn").desc(), "ReservationID")


def event_list(T: Tables, ordered: bool = True) -> DataFrame:
    """C8."""
    df = _events_with_hall_and_host(T).select(
        "EventID", "EventType", "EventDate", "EventDuration", "HallID", "HallName", "HostName"
    )
    return _sort(df, ordered, "EventDate", "EventID")


def order_list(T: Tables, ordered: bool = True) -> DataFrame:
    """C9."""
    rest = T["restaurant"].select("RestaurantID", "RestaurantName")
    df = (
        T["restaurant_order"]
        .join(_names(T, "CustomerID", "CustomerName"), "CustomerID")
        .join(rest, "RestaurantID")
        .select("OrderID", "CustomerID", "CustomerName", "RestaurantID", "RestaurantName", "InvoiceID", "OrderDetails")
    )
    return _sort(df, ordered, "OrderID")


def feedback_list(T: Tables, ordered: bool = True) -> DataFrame:
    """Latest feedback first."""
    df = T["customer_feedback"].join(_names(T, "CustomerID", "CustomerName"), "CustomerID").select(
        "FeedbackID", "CustomerID", "CustomerName", "Rating", "Comments", "FeedbackDate"
    )
    return _sort(df, ordered, F.col("FeedbackDate").desc(), "FeedbackID")


REQUEST_COLUMNS = [
    "RequestToken",
    "CustomerID",
    "CustomerFName",
    "CustomerLName",
    "PhoneNumber",
    "RoomType",
    "CheckIn",
    "CheckOut",
    "Status",
    "RoomNo",
    "StaffID",
    "RequestDate",
]


def _requests_with_guest(T: Tables, requests: DataFrame | None = None) -> DataFrame:
    c = T["customer"].select("CustomerID", "CustomerFName", "CustomerLName", "PhoneNumber")
    return (requests if requests is not None else T["reservation_request"]).join(c, "CustomerID")


def request_list(T: Tables, ordered: bool = True) -> DataFrame:
    """C11: Pending, Approved, Declined (others first), then latest request date."""
    df = _requests_with_guest(T).select(*REQUEST_COLUMNS)
    return _sort(df, ordered, status_rank("Status"), F.col("RequestDate").desc(), "RequestToken")


def request_status(T: Tables, tokens, ordered: bool = False) -> DataFrame:
    """Requests looked up by token (typed by a guest: trimmed, upper-cased)."""
    rq = T["reservation_request"]
    if isinstance(tokens, str):
        picked = rq.where(F.col("RequestToken") == normalise_token(F.lit(tokens)))
    else:
        wanted = (
            _ids_frame(tokens, "RequestToken", rq)
            .select(normalise_token("RequestToken").alias("RequestToken"))
            .distinct()
        )
        picked = rq.join(wanted, "RequestToken", "left_semi")
    df = _requests_with_guest(T, picked).select(*REQUEST_COLUMNS[:10])
    return _sort(df, ordered, "RequestToken")


def request_room_matches(T: Tables, ordered: bool = False) -> DataFrame:
    """For each Pending request, the vacant rooms of the same type.

    Listing every (request, room) pair grows as pending x vacant per type, so
    the vacant rooms are first reduced to one row per type - the count and
    the cheapest room (lowest number among equal rates) as the suggestion,
    the first entry of the type in B3's order - and that summary is joined
    to the requests.  Requests without a match keep a row (count 0).
    """
    vacant = available_rooms(T, ordered=False)
    per_type = vacant.groupBy("RoomType").agg(
        F.count(F.lit(1)).alias("MatchingRooms"),
        F.min(F.struct("RoomRate", "RoomNo")).alias("best"),
    )
    pending = T["reservation_request"].where(F.col("Status") == "Pending").select("RequestToken", "RoomType")
    df = pending.join(per_type, "RoomType", "left").select(
        "RequestToken",
        "RoomType",
        F.col("best.RoomNo").alias("RoomNo"),
        F.col("best.RoomRate").alias("RoomRate"),
        F.coalesce("MatchingRooms", F.lit(0).cast("bigint")).alias("MatchingRooms"),
    )
    return _sort(df, ordered, "RequestToken")


def customers_ordering(T: Tables, item: str, ordered: bool = False) -> DataFrame:
    """C14: customers with an order whose text contains ``item`` (any case, with or without accents)."""
    # DISTINCT as in the model's subquery: a partial aggregate drops repeat
    # buyers before the shuffle, and the semi join reuses its partitioning
    buyers = T["restaurant_order"].where(contains_item("OrderDetails", item)).select("CustomerID").distinct()
    df = T["customer"].join(buyers, "CustomerID", "left_semi").select(
        "CustomerID", "CustomerFName", "CustomerLName"
    )
    return _sort(df, ordered, "CustomerID")


def rooms_above_average(T: Tables, ordered: bool = False) -> DataFrame:
    """Rooms whose rate is above the average rate (scalar subquery)."""
    room = T["room"]
    avg_rate = room.select(F.avg("RoomRate")).scalar()
    df = room.where(F.col("RoomRate") > avg_rate).select("RoomNo", "RoomType", "RoomRate")
    return _sort(df, ordered, "RoomNo")
