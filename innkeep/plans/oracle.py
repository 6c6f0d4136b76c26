"""DuckDB formulation of the table adapter, shared by every oracle query.

The Spark adapter (:mod:`innkeep.sources.adapter`) and this SQL are two
independent writings of the same mapping; the oracle queries are written
the way the bookings SQL reads (plain joins, GROUP BY, subqueries) rather
than the way the Spark plans are built, so that they check each other.

DuckDB pitfalls handled here: ``concat()`` skips NULLs (use ``||``),
``count_if``/``sum(int)`` are HUGEINT (cast to BIGINT), integer ``//``
truncates, casting a double to BIGINT rounds (use ``trunc``), and decimal
division is done in integers and converted once at the end.
"""

from __future__ import annotations

N_PARTS = "(SELECT count(*) FROM part)"
N_CUSTOMERS = "(SELECT count(*) FROM customer)"
HALF_SUPPLIERS = "((SELECT count(*) FROM supplier) // 2)"

SHIFT_OF = "CASE {k} % 3 WHEN 0 THEN 'Morning' WHEN 1 THEN 'Afternoon' ELSE 'Evening' END"
CHECK_IN = "o_orderdate + INTERVAL 14 HOUR"
CHECK_OUT = "o_orderdate + to_days(CAST(1 + o_orderkey % 7 AS INTEGER)) + to_hours(o_orderkey % 24)"
FRONT_DESK_OF = f"2 * (o_orderkey % ({HALF_SUPPLIERS} - 1))"

ADAPTER_CTES = f"""
hotel_staff AS (
  SELECT s_suppkey AS StaffID, 'Supplier' AS StaffFName, substr(s_name, 10) AS StaffLName,
         CASE WHEN s_suppkey % 2 = 0 THEN 'Front Desk' ELSE 'Housekeeping' END AS StaffRole
  FROM supplier),
hotel_frontdesk AS (
  SELECT s_suppkey AS StaffID, {SHIFT_OF.format(k="s_suppkey")} AS Shift
  FROM supplier WHERE s_suppkey % 2 = 0),
hotel_housekeeping AS (
  SELECT s_suppkey AS StaffID, {SHIFT_OF.format(k="s_suppkey")} AS Shift,
         CAST(s_suppkey % 21 AS INTEGER) AS AssignedFloor
  FROM supplier WHERE s_suppkey % 2 = 1),
hotel_customer AS (
  SELECT c_custkey AS CustomerID, c_mktsegment AS CustomerFName, substr(c_name, 10) AS CustomerLName,
         '0' || lpad(CAST(c_custkey - CASE WHEN c_custkey % 50 = 1 THEN 1 ELSE 0 END AS VARCHAR), 9, '0')
           AS PhoneNumber
  FROM customer),
hotel_conference_hall AS (
  SELECT CAST(n_nationkey AS BIGINT) AS HallID, 'HALL_' || CAST(n_nationkey % 20 AS VARCHAR) AS HallName,
         CAST(50 + 10 * n_nationkey AS INTEGER) AS Capacity
  FROM nation),
hotel_restaurant AS (
  SELECT CAST(r_regionkey AS BIGINT) AS RestaurantID, r_name AS RestaurantName,
         CAST(40 + 20 * r_regionkey AS INTEGER) AS SeatingCapacity
  FROM region),
hotel_room AS (
  SELECT p_partkey AS RoomNo, p_type AS RoomType, CAST(p_retailprice AS DECIMAL(10,2)) AS RoomRate,
         CASE WHEN p_size % 2 = 0 THEN 'Occupied' ELSE 'Vacant' END AS RoomStatus,
         CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE 2 * (p_partkey % {HALF_SUPPLIERS}) + 1 END
           AS HousekeeperID
  FROM part),
hotel_reservation AS (
  SELECT o_orderkey AS ReservationID, (7 * o_orderkey + 13 * o_custkey) % {N_PARTS} AS RoomID,
         o_custkey AS CustomerID, {FRONT_DESK_OF} AS StaffID, {CHECK_IN} AS CheckIn,
         CASE WHEN o_orderstatus = 'O' AND o_orderkey % 10 = 0 THEN NULL ELSE {CHECK_OUT} END AS CheckOut
  FROM orders),
hotel_event AS (
  SELECT event_id AS EventID,
         CASE event_type WHEN 'click' THEN 'Wedding' WHEN 'error' THEN 'Conference'
              WHEN 'purchase' THEN 'Seminar' WHEN 'signup' THEN 'Networking Event'
              WHEN 'view' THEN 'Birthday Party' END AS EventType,
         CAST(ts AS DATE) AS EventDate,
         CAST((event_id % 16 + 1) * 0.5 AS DECIMAL(4,1)) AS EventDuration,
         user_id AS Host, event_id % 24 AS HallID
  FROM events),
hotel_invoice AS (
  SELECT o_orderkey AS InvoiceNo, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey END AS ReservationID,
         o_custkey AS CustomerID, CAST(o_totalprice AS DECIMAL(10,2)) AS AmountPayable,
         CASE o_orderstatus
           WHEN 'F' THEN CAST(o_totalprice AS DECIMAL(10,2))
           WHEN 'P' THEN CAST(floor(CAST(o_totalprice AS DECIMAL(10,2))) AS DECIMAL(10,2))
           ELSE CAST(0 AS DECIMAL(10,2)) END AS AmountPaid
  FROM orders WHERE o_orderkey % 4 <> 0),
hotel_orders_part AS (
  SELECT numbered.* EXCLUDE (part_of), p_partkey, p_name, p_type
  FROM (SELECT *, o_orderkey % {N_PARTS} AS part_of FROM orders) AS numbered JOIN part ON part_of = p_partkey),
hotel_restaurant_order AS (
  SELECT o_orderkey AS OrderID, o_custkey AS CustomerID, o_orderkey % 5 AS RestaurantID,
         CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderkey END AS InvoiceID,
         CAST(1 + o_orderkey % 4 AS VARCHAR) || 'x ' || p_name AS OrderDetails
  FROM hotel_orders_part),
hotel_customer_feedback AS (
  SELECT doc_id AS FeedbackID, doc_id % {N_CUSTOMERS} AS CustomerID, CAST(n_chars % 6 AS INTEGER) AS Rating,
         text AS Comments, CAST(DATE '2026-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS FeedbackDate
  FROM documents),
hotel_reservation_request AS (
  SELECT 'RQ-' || CAST(o_orderkey AS VARCHAR) AS RequestToken, o_custkey AS CustomerID, p_type AS RoomType,
         {CHECK_IN} AS CheckIn, {CHECK_OUT} AS CheckOut,
         CASE o_orderstatus WHEN 'O' THEN 'Pending' WHEN 'F' THEN 'Approved' WHEN 'P' THEN 'Declined' END AS Status,
         CASE WHEN o_orderstatus = 'F' THEN p_partkey END AS RoomNo,
         CASE WHEN o_orderstatus = 'F' THEN {FRONT_DESK_OF} END AS StaffID,
         CAST(o_orderdate AS DATE) AS RequestDate
  FROM hotel_orders_part WHERE o_orderkey % 5 = 0)
"""


def with_adapter(body: str) -> str:
    """Full oracle text: the adapter CTEs, then ``body`` as a subquery."""
    return f"WITH {ADAPTER_CTES.strip()}\nSELECT * FROM (\n{body.strip()}\n) AS oracle_result"


# Shared SQL fragments -----------------------------------------------------------

def full_name_sql(first: str, last: str) -> str:
    return f"({first} || ' ' || {last})"


def nights_sql(check_in: str, check_out: str) -> str:
    d = 86400000000
    diff = f"(epoch_us({check_out}) - epoch_us({check_in}))"
    rest = f"((({diff} % {d}) + {d}) % {d})"
    return (
        f"greatest(CAST(1 AS BIGINT), ({diff} - {rest}) // {d} "
        f"+ CASE WHEN {rest} // 1000000 > 43200 THEN 1 ELSE 0 END)"
    )


def charge_sql(nights: str, rate: str) -> str:
    """round(nights * rate * 1.125, 2) on the exact binary value, half to even."""
    two62 = 1 << 62
    two61 = 1 << 61
    r = f"(CASE WHEN {rate} IS NULL OR {rate} = 0 THEN CAST(100.0 AS DOUBLE) ELSE CAST({rate} AS DOUBLE) END)"
    p = f"((CAST({nights} AS DOUBLE) * {r}) * CAST(1.125 AS DOUBLE))"
    z = f"(CAST(trunc(({p} - floor({p})) * CAST({two62} AS DOUBLE)) AS HUGEINT) * 100)"
    q = f"(CAST(floor({p}) AS HUGEINT) * 100 + {z} // {two62})"
    rem = f"({z} % {two62})"
    cents = f"({q} + CASE WHEN {rem} > {two61} OR ({rem} = {two61} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
    return f"TRY_CAST({cents} / CAST(100 AS DOUBLE) AS DECIMAL(10,2))"


def pct_hundredths_sql(part: str, total: str) -> str:
    return f"(CASE WHEN {total} = 0 THEN 0 ELSE ({part} * 20000 + {total}) // (2 * {total}) END)"


def avg_cents_sql(col: str) -> str:
    """round(avg(col), 2) as the engines compute it for DECIMAL(10,2):
    the mean rounded half up to 6 places, then to 2 places."""
    s = f"CAST(sum({col}) * 100 AS BIGINT)"
    n = "count(*)"
    a6 = f"(({s} * 10000 * 2 + {n}) // (2 * {n}))"
    a2 = f"(({a6} * 2 + 10000) // 20000)"
    return f"CAST({a2} / CAST(100 AS DOUBLE) AS DECIMAL(10,2))"
