"""Registry of the library's queries with their DuckDB oracle SQL.

Each entry is ``name -> (builder, oracle body)``.  A builder takes a
:class:`Context` (the driver tables and the derived bookings tables of one
directory) and returns a lazy DataFrame; the oracle body is a DuckDB SELECT
over the adapter CTEs of :mod:`innkeep.plans.oracle`.  The same column
names are used on both sides.  Entries without an oracle (``None``) get a
row-count check only.

Every query runs over whole tables.  The fixed parameters below (report
date, price cap, hours threshold, item) are the report settings, not data
subsets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalar as H
from ..operators import quality, reports, views
from ..sources import schema as S
from ..sources.tables import load_tables, read_driver_tables
from . import oracle as O

AS_OF = "2024-01-15"
PRICE_CAP = Decimal("950.00")
MIN_HOURS = Decimal("2.0")
ITEM = "widget"


@dataclass
class Context:
    spark: SparkSession
    directory: str
    _raw: dict | None = field(default=None, repr=False)
    _tables: dict | None = field(default=None, repr=False)

    @property
    def raw(self) -> dict[str, DataFrame]:
        if self._raw is None:
            self._raw = read_driver_tables(self.spark, self.directory)
        return self._raw

    @property
    def T(self) -> dict[str, DataFrame]:
        if self._tables is None:
            self._tables = load_tables(self.spark, self.directory)
        return self._tables


Builder = Callable[[Context], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, oracle: str | None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, oracle)
        return fn

    return deco


FN = O.full_name_sql

# ------------------------------------------------------------------ B listings

register("customer_directory", """
SELECT CustomerID, CustomerFName, CustomerLName, PhoneNumber FROM hotel_customer ORDER BY CustomerID
""")(lambda c: views.customer_directory(c.T))

register("vacant_rooms_under", f"""
SELECT RoomNo, RoomType, RoomRate FROM hotel_room
WHERE RoomStatus = 'Vacant' AND RoomRate < {PRICE_CAP}
""")(lambda c: views.vacant_rooms_under(c.T, PRICE_CAP))

register("available_rooms", """
SELECT RoomNo, RoomType, RoomRate FROM hotel_room WHERE RoomStatus = 'Vacant' ORDER BY RoomType, RoomRate
""")(lambda c: views.available_rooms(c.T))

register("housekeepers", """
SELECT StaffID, StaffFName, StaffLName, StaffRole FROM hotel_staff
WHERE StaffRole = 'Housekeeping' ORDER BY StaffID
""")(lambda c: views.housekeepers(c.T))

register("halls", "SELECT HallID, HallName, Capacity FROM hotel_conference_hall ORDER BY HallID")(
    lambda c: views.halls(c.T)
)

register("restaurants", """
SELECT RestaurantID, RestaurantName, SeatingCapacity FROM hotel_restaurant ORDER BY RestaurantID
""")(lambda c: views.restaurants(c.T))

register("invoices", """
SELECT InvoiceNo, ReservationID, CustomerID, AmountPayable, AmountPaid FROM hotel_invoice ORDER BY InvoiceNo
""")(lambda c: views.invoices(c.T))

register("public_rooms", """
SELECT RoomNo, RoomType, RoomRate FROM hotel_room WHERE RoomStatus = 'Vacant'
""")(lambda c: views.public_rooms(c.T))

register("public_events", f"""
WITH shown AS (SELECT * FROM hotel_event WHERE EventDate >= DATE '{AS_OF}' AND EXISTS (
  SELECT 1 FROM hotel_customer AS person WHERE person.CustomerID = Host))
SELECT EventType, EventDate, EventDuration, HallName, Capacity FROM hotel_conference_hall JOIN shown USING (HallID)
""")(lambda c: views.public_events(c.T, AS_OF))


@register("customer_reservations", """
SELECT ReservationID, RoomID, CheckIn, CheckOut FROM hotel_reservation
WHERE CustomerID IN (SELECT CustomerID FROM hotel_reservation_request)
""")
def _customer_reservations(c: Context) -> DataFrame:
    # the stays of every customer who has sent a booking request
    return views.customer_reservations(c.T, c.T["reservation_request"].select("CustomerID"))


# ---------------------------------------------------------------------- C joins

register("rooms_with_housekeeper", f"""
WITH cleaner AS (SELECT StaffID AS HousekeeperID, {FN('StaffFName', 'StaffLName')} AS HousekeeperName FROM hotel_staff)
SELECT * EXCLUDE (HousekeeperName), HousekeeperName FROM hotel_room LEFT JOIN cleaner USING (HousekeeperID)
""")(lambda c: views.rooms_with_housekeeper(c.T))

register("active_reservations", f"""
WITH guest AS (SELECT CustomerID, {FN('CustomerFName', 'CustomerLName')} AS GuestName FROM hotel_customer),
still_open AS (SELECT * FROM hotel_reservation WHERE CheckOut IS NULL)
SELECT ReservationID, RoomID, GuestName, CheckIn, CheckOut FROM guest JOIN still_open USING (CustomerID)
""")(lambda c: views.active_reservations(c.T))

register("room_occupancy", f"""
WITH guest AS (SELECT CustomerID, {FN('CustomerFName', 'CustomerLName')} AS GuestName FROM hotel_customer),
taken AS (SELECT RoomID AS RoomNo, * EXCLUDE (RoomID, StaffID) FROM hotel_reservation WHERE CheckOut IS NULL)
SELECT RoomNo, RoomType, RoomRate, RoomStatus, ReservationID,
       CASE WHEN GuestName IS NOT NULL THEN CustomerID END AS CustomerID, GuestName, CheckIn, CheckOut
FROM hotel_room JOIN taken USING (RoomNo) LEFT JOIN guest USING (CustomerID)
UNION ALL
SELECT RoomNo, RoomType, RoomRate, RoomStatus, NULL, NULL, NULL, NULL, NULL
FROM hotel_room WHERE RoomNo NOT IN (SELECT RoomNo FROM taken)
""")(lambda c: views.room_occupancy(c.T))

register("outstanding_invoices", f"""
WITH guest AS (SELECT CustomerID, {FN('CustomerFName', 'CustomerLName')} AS CustomerName FROM hotel_customer),
owed AS (SELECT *, AmountPayable - AmountPaid AS BalanceDue FROM hotel_invoice)
SELECT InvoiceNo, CustomerID, CustomerName, ReservationID, AmountPayable, AmountPaid, BalanceDue
FROM guest JOIN owed USING (CustomerID) WHERE BalanceDue > 0
""")(lambda c: views.outstanding_invoices(c.T))

register("staff_directory", f"""
WITH posts AS (
  SELECT StaffID, Shift, AssignedFloor, 1 AS pick FROM hotel_housekeeping
  UNION ALL SELECT StaffID, Shift, NULL, 2 FROM hotel_frontdesk),
post AS (SELECT StaffID, arg_min(Shift, pick) AS Shift, max(AssignedFloor) AS AssignedFloor FROM posts GROUP BY StaffID)
SELECT StaffID, {FN('StaffFName', 'StaffLName')} AS StaffName, StaffRole, Shift, AssignedFloor
FROM hotel_staff LEFT JOIN post USING (StaffID)
""")(lambda c: views.staff_directory(c.T))

register("upcoming_events", f"""
WITH organiser AS (SELECT CustomerID AS HostID, {FN('CustomerFName', 'CustomerLName')} AS HostName FROM hotel_customer),
ahead AS (SELECT * EXCLUDE (Host), Host AS HostID FROM hotel_event WHERE EventDate >= DATE '{AS_OF}')
SELECT EventID, EventType, EventDate, EventDuration, HallID, HallName, Capacity, HostID, HostName
FROM organiser JOIN ahead USING (HostID) JOIN hotel_conference_hall USING (HallID)
""")(lambda c: views.upcoming_events(c.T, AS_OF))

register("reservation_list", f"""
WITH guest AS (SELECT CustomerID, {FN('CustomerFName', 'CustomerLName')} AS CustomerName FROM hotel_customer)
SELECT ReservationID, RoomID, CustomerID, CustomerName, StaffID, CheckIn, CheckOut
FROM guest JOIN hotel_reservation USING (CustomerID)
""")(lambda c: views.reservation_list(c.T))

register("event_list", f"""
WITH organiser AS (SELECT CustomerID AS Host, {FN('CustomerFName', 'CustomerLName')} AS HostName FROM hotel_customer),
hall AS (SELECT HallID, HallName FROM hotel_conference_hall)
SELECT EventID, EventType, EventDate, EventDuration, HallID, HallName, HostName
FROM hall JOIN hotel_event USING (HallID) JOIN organiser USING (Host)
""")(lambda c: views.event_list(c.T))

register("order_list", f"""
WITH guest AS (SELECT CustomerID, {FN('CustomerFName', 'CustomerLName')} AS CustomerName FROM hotel_customer),
place AS (SELECT RestaurantID, RestaurantName FROM hotel_restaurant)
SELECT OrderID, CustomerID, CustomerName, RestaurantID, RestaurantName, InvoiceID, OrderDetails
FROM place JOIN hotel_restaurant_order USING (RestaurantID) JOIN guest USING (CustomerID)
""")(lambda c: views.order_list(c.T))

register("feedback_list", f"""
WITH guest AS (SELECT CustomerID, {FN('CustomerFName', 'CustomerLName')} AS CustomerName FROM hotel_customer)
SELECT FeedbackID, CustomerID, CustomerName, Rating, Comments, FeedbackDate
FROM guest JOIN hotel_customer_feedback USING (CustomerID)
""")(lambda c: views.feedback_list(c.T))

_REQUEST_SELECT = """
SELECT RequestToken, CustomerID, CustomerFName, CustomerLName, PhoneNumber, RoomType, CheckIn, CheckOut, Status, RoomNo{extra}
FROM hotel_customer JOIN hotel_reservation_request USING (CustomerID)
"""

register("request_list", _REQUEST_SELECT.format(extra=", StaffID, RequestDate"))(lambda c: views.request_list(c.T))


@register("request_status", _REQUEST_SELECT.format(extra="") + """
WHERE RequestToken IN (
  SELECT upper(trim(' ' || lower(RequestToken) || '  ')) FROM hotel_reservation_request WHERE Status = 'Pending')
""")
def _request_status(c: Context) -> DataFrame:
    # tokens as a guest types them: lower case, stray spaces (normalised by H13)
    typed = c.T["reservation_request"].where(F.col("Status") == "Pending").select(
        F.concat(F.lit(" "), F.lower("RequestToken"), F.lit("  ")).alias("token")
    )
    return views.request_status(c.T, typed)


register("request_room_matches", """
WITH vacant AS (
  SELECT RoomType, RoomNo, RoomRate,
         row_number() OVER (PARTITION BY RoomType ORDER BY RoomRate, RoomNo) AS pos,
         count(*) OVER (PARTITION BY RoomType) AS n
  FROM hotel_room WHERE RoomStatus = 'Vacant')
SELECT q.RequestToken, q.RoomType, v.RoomNo, v.RoomRate, COALESCE(v.n, 0) AS MatchingRooms
FROM hotel_reservation_request q
LEFT JOIN vacant v ON v.RoomType = q.RoomType AND v.pos = 1
WHERE q.Status = 'Pending'
""")(lambda c: views.request_room_matches(c.T))

register("customers_ordering", f"""
WITH asked AS (
  SELECT CustomerID FROM hotel_restaurant_order GROUP BY CustomerID
  HAVING bool_or(contains(lower(OrderDetails), lower('{ITEM}'))))
SELECT CustomerID, CustomerFName, CustomerLName FROM hotel_customer SEMI JOIN asked USING (CustomerID)
""")(lambda c: views.customers_ordering(c.T, ITEM))

# the same orders with accents, capitals, and ß for ss
_MENU_SQL = """
WITH menu AS (
  SELECT CustomerID, CASE WHEN OrderID % 3 = 0 THEN replace(replace(OrderDetails, 'e', 'é'), 'i', 'ï')
                          WHEN OrderID % 3 = 1 THEN upper(OrderDetails) ELSE OrderDetails END
         || CASE WHEN OrderID % 50 = 7 THEN ' mit Eßbesteck' WHEN OrderID % 50 = 9 THEN ' MIT ESSBESTECK' ELSE '' END AS Details
  FROM hotel_restaurant_order)
"""


def _menu(c: Context) -> dict[str, DataFrame]:
    k, text = F.col("OrderID"), F.col("OrderDetails")
    other = F.when(k % 3 == 0, F.translate(text, "ei", "éï")).when(k % 3 == 1, F.upper(text)).otherwise(text)
    extra = F.when(k % 50 == 7, " mit Eßbesteck").when(k % 50 == 9, " MIT ESSBESTECK").otherwise("")
    return {**c.T, "restaurant_order": c.T["restaurant_order"].withColumn("OrderDetails", F.concat(other, extra))}


for _name, _item in (("accents", "rÉd wid"), ("sharp_s", "essBesteck")):
    register(f"customers_ordering_{_name}", _MENU_SQL + f"""
SELECT CustomerID, CustomerFName, CustomerLName FROM hotel_customer WHERE CustomerID IN (
  SELECT CustomerID FROM menu WHERE contains(replace(strip_accents(lower(Details)), 'ß', 'ss'), replace(strip_accents(lower('{_item}')), 'ß', 'ss')))
""")(lambda c, item=_item: views.customers_ordering(_menu(c), item))

register("rooms_above_average", """
SELECT RoomNo, RoomType, RoomRate FROM hotel_room
WHERE RoomRate * (SELECT count(*) FROM hotel_room) > (SELECT sum(RoomRate) FROM hotel_room)
""")(lambda c: views.rooms_above_average(c.T))

# ---------------------------------------------------------------- D aggregates

register("room_type_summary", f"""
SELECT RoomType, count(*) AS TotalRooms, {O.avg_cents_sql('RoomRate')} AS AverageRate
FROM hotel_room GROUP BY RoomType
""")(lambda c: reports.room_type_summary(c.T))

register("hall_hours_over", f"""
WITH hours AS (SELECT HallID, sum(EventDuration) AS d FROM hotel_event GROUP BY HallID),
named AS (SELECT HallName, CAST(sum(d) AS DECIMAL(14,1)) AS TotalHoursBooked FROM hotel_conference_hall JOIN hours USING (HallID) GROUP BY HallName)
SELECT HallName, TotalHoursBooked FROM named WHERE TotalHoursBooked > {MIN_HOURS}
""")(lambda c: reports.hall_hours_over(c.T, MIN_HOURS))

register("room_inventory_report", f"""
SELECT RoomType, count(*) AS TotalRooms, {O.avg_cents_sql('RoomRate')} AS AvgRate,
       count(*) FILTER (RoomStatus = 'Occupied') AS OccupiedCount, count(*) FILTER (RoomStatus = 'Vacant') AS VacantCount
FROM hotel_room GROUP BY ALL
""")(lambda c: reports.room_inventory_report(c.T))

register("frontdesk_workload", f"""
WITH handled AS (SELECT StaffID, count(*) AS n FROM hotel_reservation GROUP BY StaffID),
desk AS (SELECT StaffID, Shift, {FN('StaffFName', 'StaffLName')} AS StaffName FROM hotel_frontdesk JOIN hotel_staff USING (StaffID))
SELECT StaffID, StaffName, Shift, coalesce(n, 0) AS ReservationsHandled FROM desk LEFT JOIN handled USING (StaffID)
""")(lambda c: reports.frontdesk_workload(c.T))

register("hall_utilisation", """
WITH used AS (
  SELECT HallID, count(*) AS n, CAST(sum(EventDuration) AS DECIMAL(14,1)) AS hours FROM hotel_event GROUP BY HallID)
SELECT HallID, HallName, Capacity, coalesce(n, 0) AS EventsHosted, hours AS TotalHoursBooked
FROM hotel_conference_hall LEFT JOIN used USING (HallID)
""")(lambda c: reports.hall_utilisation(c.T))

_OCC = "CAST(count_if(RoomStatus = 'Occupied') AS BIGINT)"
_PCT = O.pct_hundredths_sql(_OCC, "count(*)")

register("occupancy_rate", f"""
SELECT CAST({_PCT} / CAST(100 AS DOUBLE) AS DECIMAL(5,2)) AS OccupiedPct FROM hotel_room
""")(lambda c: reports.occupancy_rate(c.T))

register("dashboard_stats", f"""
SELECT CAST(count_if(RoomStatus = 'Vacant') AS BIGINT) AS unoccupied_rooms,
       {_OCC} AS occupied_rooms,
       {_PCT} / CAST(100 AS DOUBLE) AS occupancy_rate,
       (SELECT count(*) FROM hotel_event WHERE EventDate >= DATE '{AS_OF}') AS upcoming_events_count
FROM hotel_room
""")(lambda c: reports.dashboard_stats(c.T, AS_OF))

register("occupancy_split", f"""
SELECT {_PCT} / CAST(100 AS DOUBLE) AS occupied_pct, (10000 - {_PCT}) / CAST(100 AS DOUBLE) AS vacant_pct
FROM hotel_room
""")(lambda c: reports.occupancy_split(c.T))

# -------------------------------------------------------------- H functions


@register("room_tax", """
SELECT RoomNo, RoomRate, CAST(RoomRate * 0.125 AS DECIMAL(10,2)) AS RoomTax FROM hotel_room
""")
def _room_tax(c: Context) -> DataFrame:
    return c.T["room"].select("RoomNo", "RoomRate", H.room_tax("RoomRate").alias("RoomTax"))


@register("stay_charges", f"""
SELECT ReservationID, RoomID, Nights, RoomRate, {O.charge_sql('Nights', 'RoomRate')} AS Charge
FROM (
  SELECT r.ReservationID, r.RoomID, {O.nights_sql('r.CheckIn', 'r.CheckOut')} AS Nights, rm.RoomRate
  FROM hotel_reservation r LEFT JOIN hotel_room rm ON rm.RoomNo = r.RoomID
  WHERE r.CheckOut IS NOT NULL)
""")
def _stay_charges(c: Context) -> DataFrame:
    from ..operators.changes import stay_bill

    closed = c.T["reservation"].where(F.col("CheckOut").isNotNull())
    return stay_bill(closed, c.T["room"]).select("ReservationID", "RoomID", "Nights", "RoomRate", "Charge")


@register("invoice_labels", """
SELECT InvoiceNo,
       CASE WHEN AmountPaid >= AmountPayable THEN 'Fully Paid' ELSE 'Record Payment' END AS PaymentState,
       COALESCE('GH₵ ' || printf('%.2f', AmountPayable), '—') AS PayableLabel,
       COALESCE('GH₵ ' || printf('%.2f', AmountPaid), '—') AS PaidLabel,
       COALESCE('GH₵ ' || printf('%.2f', AmountPayable - AmountPaid), '—') AS BalanceLabel
FROM hotel_invoice
""")
def _invoice_labels(c: Context) -> DataFrame:
    return c.T["invoice"].select(
        "InvoiceNo",
        H.payment_state("AmountPayable", "AmountPaid").alias("PaymentState"),
        H.money_label("AmountPayable").alias("PayableLabel"),
        H.money_label("AmountPaid").alias("PaidLabel"),
        H.money_label(H.balance_due("AmountPayable", "AmountPaid")).alias("BalanceLabel"),
    )


@register("stay_states", """
SELECT ReservationID, CASE WHEN CheckOut IS NULL THEN 'Stay Active' ELSE 'Checked out' END AS StayState
FROM hotel_reservation
""")
def _stay_states(c: Context) -> DataFrame:
    return c.T["reservation"].select("ReservationID", H.stay_state("CheckOut").alias("StayState"))


@register("feedback_stars", """
SELECT FeedbackID, Rating, repeat('★', Rating) || repeat('☆', 5 - Rating) AS Stars FROM hotel_customer_feedback
""")
def _feedback_stars(c: Context) -> DataFrame:
    return c.T["customer_feedback"].select("FeedbackID", "Rating", H.rating_stars("Rating").alias("Stars"))


@register("request_labels", """
SELECT RequestToken,
       CASE Status WHEN 'Approved' THEN 'Approved & Confirmed' WHEN 'Declined' THEN 'Declined'
            ELSE 'Pending Review' END AS GuestLabel,
       CASE Status WHEN 'Pending' THEN 'Pending' WHEN 'Approved' THEN 'Approved (Room ' || CAST(RoomNo AS VARCHAR) || ')'
            ELSE 'Declined' END AS StaffLabel
FROM hotel_reservation_request
""")
def _request_labels(c: Context) -> DataFrame:
    return c.T["reservation_request"].select(
        "RequestToken",
        H.request_label("Status", "RoomNo", "guest").alias("GuestLabel"),
        H.request_label("Status", "RoomNo", "staff").alias("StaffLabel"),
    )


@register("room_board", f"""
SELECT rm.RoomNo, COALESCE(NULLIF({FN('s.StaffFName', 's.StaffLName')}, ''), 'Unassigned') AS HousekeeperLabel,
       COALESCE(NULLIF({FN('c.CustomerFName', 'c.CustomerLName')}, ''), '—') AS GuestLabel
FROM hotel_room rm
LEFT JOIN hotel_staff s ON s.StaffID = rm.HousekeeperID
LEFT JOIN hotel_reservation r ON r.RoomID = rm.RoomNo AND r.CheckOut IS NULL
LEFT JOIN hotel_customer c ON c.CustomerID = r.CustomerID
""")
def _room_board(c: Context) -> DataFrame:
    # C1 and C3 labelled for display (H11); a room with two open stays has two rows
    hk = views.rooms_with_housekeeper(c.T, ordered=False).select("RoomNo", "HousekeeperName")
    occ = views.room_occupancy(c.T).select("RoomNo", "GuestName")
    return occ.join(hk, "RoomNo").select(
        "RoomNo",
        H.default_label("HousekeeperName", H.UNASSIGNED).alias("HousekeeperLabel"),
        H.default_label("GuestName").alias("GuestLabel"),
    )


@register("staff_board", """
SELECT s.StaffID, COALESCE(NULLIF(COALESCE(h.Shift, f.Shift), ''), '—') AS ShiftLabel,
       COALESCE(CAST(h.AssignedFloor AS VARCHAR), '—') AS FloorLabel
FROM hotel_staff s
LEFT JOIN hotel_housekeeping h ON h.StaffID = s.StaffID
LEFT JOIN hotel_frontdesk f ON f.StaffID = s.StaffID
""")
def _staff_board(c: Context) -> DataFrame:
    return views.staff_directory(c.T, ordered=False).select(
        "StaffID",
        H.default_label("Shift").alias("ShiftLabel"),
        H.default_label("AssignedFloor", falsy=False).alias("FloorLabel"),
    )


# ------------------------------------------------------------ J quality checks

LINEITEM = S.TableSpec(
    "lineitem",
    (S.Col("l_orderkey", S.T.LongType()), S.Col("l_linenumber", S.T.IntegerType())),
    ("l_orderkey", "l_linenumber"),
)


def _v(table: str, rule: str, column: str, key: str, value: str, source: str, where: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{rule}' AS rule, '{column}' AS column_name, "
        f"CAST({key} AS VARCHAR) AS row_key, CAST({value} AS VARCHAR) AS bad_value FROM {source} WHERE {where}"
    )


def _key_sql(spec: S.TableSpec) -> str:
    if len(spec.key) == 1:
        return spec.key[0]
    return "concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in spec.key) + ")"


def _unique_sql() -> str:
    parts = []
    for spec in [*S.SPECS.values(), LINEITEM]:
        src = spec.name if spec is LINEITEM else f"hotel_{spec.name}"
        keys = ", ".join(spec.key)
        parts.append(
            f"SELECT '{spec.name}' AS table_name, 'unique' AS rule, '{','.join(spec.key)}' AS column_name, "
            f"CAST({_key_sql(spec)} AS VARCHAR) AS row_key, CAST(count(*) AS VARCHAR) AS bad_value "
            f"FROM {src} GROUP BY {keys} HAVING count(*) > 1"
        )
    return "\nUNION ALL\n".join(parts)


def _row_rule_sql(rule: str, only: dict[str, str] | None = None) -> str:
    parts = []
    for spec in S.SPECS.values():
        if only is not None and spec.name not in only:
            continue
        src = f"hotel_{spec.name}" if only is None else only[spec.name]
        key = _key_sql(spec)
        for col in spec.columns:
            if rule == "not_null" and not col.nullable:
                parts.append(_v(spec.name, rule, col.name, key, col.name, src, f"{col.name} IS NULL"))
            elif rule == "enum" and col.values:
                vals = ", ".join(f"'{v}'" for v in col.values)
                parts.append(_v(spec.name, rule, col.name, key, col.name, src, f"{col.name} NOT IN ({vals})"))
            elif rule == "range" and col.between:
                lo, hi = col.between
                parts.append(_v(spec.name, rule, col.name, key, col.name, src, f"{col.name} NOT BETWEEN {lo} AND {hi}"))
            elif rule == "size":
                # identifiers are numeric in the derived tables: no VARCHAR length to check
                if col.max_len and not col.is_id:
                    parts.append(_v(spec.name, rule, col.name, key, col.name, src, f"length({col.name}) > {col.max_len}"))
                if isinstance(col.dtype, S.T.DecimalType):
                    lim = 10 ** (col.dtype.precision - col.dtype.scale)
                    parts.append(_v(spec.name, rule, col.name, key, col.name, src, f"abs({col.name}) >= {lim}"))
    return "\nUNION ALL\n".join(parts)


def _fk_sql(only: dict[str, str] | None = None, parents: dict[str, str] | None = None) -> str:
    parts = []
    for spec in S.SPECS.values():
        if only is not None and spec.name not in only:
            continue
        src = f"hotel_{spec.name}" if only is None else only[spec.name]
        for fk in spec.foreign_keys:
            parts.append(
                _v(spec.name, "foreign_key", fk.column, _key_sql(spec), f"c.{fk.column}", f"{src} c",
                   f"c.{fk.column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {(parents or {}).get(fk.parent, f'hotel_{fk.parent}')} p "
                   f"WHERE p.{fk.parent_column} = c.{fk.column})")
            )
    return "\nUNION ALL\n".join(parts)


def _hotel_and_lineitem_unique(c: Context) -> DataFrame:
    frames = [quality.check_all(c.T, ("unique",)), quality.check_unique(c.raw["lineitem"], LINEITEM)]
    return frames[0].unionByName(frames[1])


register("check_unique", _unique_sql())(_hotel_and_lineitem_unique)
register("check_not_null", _row_rule_sql("not_null"))(lambda c: quality.check_all(c.T, ("not_null",)))
register("check_enum", _row_rule_sql("enum"))(lambda c: quality.check_all(c.T, ("enum",)))
register("check_range", _row_rule_sql("range"))(lambda c: quality.check_all(c.T, ("range",)))
register("check_size", _row_rule_sql("size"))(lambda c: quality.check_all(c.T, ("size",)))
register("check_foreign_key", _fk_sql())(lambda c: quality.check_all(c.T, ("foreign_key",)))
register("check_stay_order", _v("reservation", "stay_order", "CheckOut", "ReservationID", "CheckOut",
                                "hotel_reservation", "CheckOut IS NOT NULL AND CheckOut <= CheckIn"))(
    lambda c: quality.check_all(c.T, ("stay_order",))
)


# the same checks on rooms and stays spoilt by a rule on the key, so that every rule has hits

_SPOILT = {"room": "spoilt_room", "reservation": "spoilt_stay"}
_SPOILT_SQL = """
WITH spoilt_room AS (
  SELECT RoomNo, CASE WHEN RoomNo % 50 <> 3 THEN RoomType END AS RoomType, RoomRate,
         CASE WHEN RoomNo % 50 = 4 THEN 'Closed' ELSE RoomStatus END AS RoomStatus,
         CASE WHEN RoomNo % 50 = 5 THEN -RoomNo ELSE HousekeeperID END AS HousekeeperID
  FROM hotel_room),
spoilt_stay AS (
  SELECT ReservationID, CASE WHEN ReservationID % 40 = 2 THEN -1 ELSE RoomID END AS RoomID,
         CASE WHEN ReservationID % 40 <> 3 THEN CustomerID END AS CustomerID, StaffID, CheckIn,
         CASE WHEN ReservationID % 40 = 1 THEN CheckIn - INTERVAL 1 HOUR ELSE CheckOut END AS CheckOut
  FROM hotel_reservation)
"""


def _spoilt(c: Context) -> dict[str, DataFrame]:
    k, r = F.col("RoomNo"), F.col("ReservationID")
    room = c.T["room"].withColumns(
        {
            "RoomType": F.when(k % 50 != 3, F.col("RoomType")),
            "RoomStatus": F.when(k % 50 == 4, "Closed").otherwise(F.col("RoomStatus")),
            "HousekeeperID": F.when(k % 50 == 5, -k).otherwise(F.col("HousekeeperID")),
        }
    )
    stay = c.T["reservation"].withColumns(
        {
            "RoomID": F.when(r % 40 == 2, -1).otherwise(F.col("RoomID")),
            "CustomerID": F.when(r % 40 != 3, F.col("CustomerID")),
            "CheckOut": F.when(r % 40 == 1, F.col("CheckIn") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("CheckOut")),
        }
    )
    return {**c.T, "room": room, "reservation": stay}


def _spoilt_check(rule: str):
    def run(c: Context) -> DataFrame:
        T = _spoilt(c)
        if rule == "foreign_key":
            frames = [f for t in _SPOILT for f in quality.check_foreign_keys(T, S.SPECS[t])]
        else:
            frames = [f for t in _SPOILT if (f := quality.check_rows(T[t], S.SPECS[t], (rule,))) is not None]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    return run


for _rule in ("not_null", "enum"):
    register(f"spoilt_{_rule}", _SPOILT_SQL + _row_rule_sql(_rule, _SPOILT))(_spoilt_check(_rule))
register("spoilt_foreign_key", _SPOILT_SQL + _fk_sql(_SPOILT))(_spoilt_check("foreign_key"))
register("spoilt_stay_order", _SPOILT_SQL + _v("reservation", "stay_order", "CheckOut", "ReservationID", "CheckOut",
                                               "spoilt_stay", "CheckOut IS NOT NULL AND CheckOut <= CheckIn"))(
    _spoilt_check("stay_order")
)


# amounts and hours wider than their columns: the DECIMAL side of J6

_WIDE_SQL = """
WITH wide_invoice AS (
  SELECT InvoiceNo, CAST(CASE WHEN InvoiceNo % 30 = 1 THEN AmountPayable + 100000000 ELSE AmountPayable END AS DECIMAL(14,2)) AS AmountPayable,
         CAST(CASE WHEN InvoiceNo % 30 = 2 THEN -100000000 - AmountPaid ELSE AmountPaid END AS DECIMAL(14,2)) AS AmountPaid
  FROM hotel_invoice),
wide_event AS (SELECT EventID, CAST(CASE WHEN EventID % 30 = 3 THEN EventDuration + 1000 ELSE EventDuration END AS DECIMAL(8,1)) AS EventDuration FROM hotel_event)
"""


def _wide(c: Context) -> DataFrame:
    k, e = F.col("InvoiceNo"), F.col("EventID")
    payable, paid, hours = F.col("AmountPayable"), F.col("AmountPaid"), F.col("EventDuration")
    invoice = c.T["invoice"].withColumns({
        "AmountPayable": F.when(k % 30 == 1, payable + 100000000).otherwise(payable).cast("decimal(14,2)"),
        "AmountPaid": F.when(k % 30 == 2, -paid - 100000000).otherwise(paid).cast("decimal(14,2)"),
    })
    event = c.T["event"].withColumn("EventDuration", F.when(e % 30 == 3, hours + 1000).otherwise(hours).cast("decimal(8,1)"))
    return quality.check_rows(invoice, S.SPECS["invoice"], ("size",)).unionByName(quality.check_rows(event, S.SPECS["event"], ("size",)))


register("spoilt_size", _WIDE_SQL + "\nUNION ALL\n".join([
    _v("invoice", "size", "AmountPayable", "InvoiceNo", "AmountPayable", "wide_invoice", "abs(AmountPayable) >= 100000000"),
    _v("invoice", "size", "AmountPaid", "InvoiceNo", "AmountPaid", "wide_invoice", "abs(AmountPaid) >= 100000000"),
    _v("event", "size", "EventDuration", "EventID", "EventDuration", "wide_event", "abs(EventDuration) >= 1000"),
]))(_wide)


# J5 from changes only: rooms taken out and put in, stays replaced; the oracle checks the tables after that in full

_AFTER = {"room": "after_room", "reservation": "after_stay", "reservation_request": "hotel_reservation_request", "invoice": "hotel_invoice"}
_AFTER_SQL = _SPOILT_SQL.rstrip() + """,
after_room AS (
  SELECT RoomNo, RoomType, RoomRate, RoomStatus, CASE WHEN RoomNo % 50 = 5 AND RoomNo % 4 = 1 THEN NULL ELSE HousekeeperID END AS HousekeeperID
  FROM spoilt_room WHERE RoomNo % 37 <> 1
  UNION ALL SELECT -1, 'Annex', 50, 'Vacant', NULL),
after_stay AS (
  SELECT ReservationID, CASE WHEN ReservationID % 40 = 7 THEN -9 ELSE RoomID END AS RoomID,
         CASE WHEN ReservationID % 40 = 11 THEN -ReservationID - 1 ELSE CustomerID END AS CustomerID, StaffID, CheckIn, CheckOut
  FROM spoilt_stay WHERE ReservationID % 41 <> 3)
"""


def _after_changes(c: Context) -> DataFrame:
    before = _spoilt(c)
    room, stay, r, v = before["room"], before["reservation"], F.col("RoomNo"), F.col("ReservationID")
    annex = room.sparkSession.range(1).select(
        F.lit(-1).cast("long").alias("RoomNo"), F.lit("Annex").alias("RoomType"), F.lit(50).cast("decimal(10,2)").alias("RoomRate"),
        F.lit("Vacant").alias("RoomStatus"), F.lit(None).cast("long").alias("HousekeeperID"),
    )
    freed = room.where((r % 50 == 5) & (r % 4 == 1) & (r % 37 != 1)).withColumn("HousekeeperID", F.lit(None).cast("long"))
    rooms_out = room.where(r % 37 == 1).select("RoomNo")
    moved = stay.where(v % 40 == 7).withColumn("RoomID", F.lit(-9).cast("long")).unionByName(stay.where(v % 40 == 11).withColumn("CustomerID", -v - 1))
    moved = moved.where(v % 41 != 3)
    stays_out = stay.where(v % 41 == 3).select("ReservationID")
    deltas = {"room": quality.Delta(freed.unionByName(annex), rooms_out), "reservation": quality.Delta(moved, stays_out)}
    after = {**before}
    for name, delta in deltas.items():
        key = S.SPECS[name].key[0]
        kept = before[name].join(delta.removed, key, "left_anti").join(delta.upserted.select(key), key, "left_anti")
        after[name] = kept.unionByName(delta.upserted)
    had = [f for t in _AFTER for f in quality.check_foreign_keys(before, S.SPECS[t])]
    previous = had[0]
    for f in had[1:]:
        previous = previous.unionByName(f)
    return quality.refresh_foreign_keys(previous, after, deltas)


register("foreign_keys_after_changes", _AFTER_SQL + _fk_sql(_AFTER, _AFTER))(_after_changes)


# --------------------------------------------------------------------- access


def names() -> list[str]:
    _load_jobs()
    return list(REGISTRY)


def build(name: str, spark: SparkSession, directory: str) -> DataFrame:
    _load_jobs()
    return REGISTRY[name][0](Context(spark, directory))


def oracle_sql(name: str) -> str | None:
    _load_jobs()
    body = REGISTRY[name][1]
    return None if body is None else O.with_adapter(body)


def _load_jobs() -> None:
    # the bulk-change jobs, sources and sinks register themselves on import
    from . import ingest, jobs  # noqa: F401
