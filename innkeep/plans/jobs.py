"""Registry entries of the bulk change jobs (I1-I21), with their oracles.

Each job runs on a change feed derived from the bookings tables (so the feed
grows with the data), written twice: as Spark DataFrames here and as DuckDB
SQL in the oracle text.  A registered query is one output of a job: a whole
new table, or the rejects.  The oracle restates the job's rules in plain SQL
(window ``row_number`` for "last wins", ``NOT IN`` subqueries for keys),
independently of the Spark plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import changes as C
from ..session import new_folder
from ..sources import keyed
from ..streaming import room_status
from . import oracle as O
from .catalog import AS_OF, Context, register

SEQ = C.SEQ
CHECKOUT_AS_OF = f"{AS_OF} 12:00:00"
TS = "timestamp_ntz"


def _days_hours(days, hours):
    return F.make_dt_interval(F.lit(days) if isinstance(days, int) else days.cast("int"),
                              F.lit(hours) if isinstance(hours, int) else hours.cast("int"))


# ----------------------------------------------------------------- helpers (SQL)

def _base36_sql(n: str) -> str:
    digits = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
    parts = [f"substr({digits}, CAST(({n} // {36 ** i}) % 36 AS INTEGER) + 1, 1)" for i in range(11, -1, -1)]
    return f"COALESCE(NULLIF(ltrim({' || '.join(parts)}, '0'), ''), '0')"


_ROOM_COLS = "RoomNo, RoomType, RoomRate, RoomStatus, HousekeeperID"
_RES_COLS = "ReservationID, RoomID, CustomerID, StaffID, CheckIn, CheckOut"
_INV_COLS = "InvoiceNo, ReservationID, CustomerID, AmountPayable, AmountPaid"
_REQ_COLS = "RequestToken, CustomerID, RoomType, CheckIn, CheckOut, Status, RoomNo, StaffID, RequestDate"


# ========================================================= I5 check-out + billing

def checkout_feed(T) -> DataFrame:
    r = T["reservation"]
    k = F.col("ReservationID")
    open_ = r.where(F.col("CheckOut").isNull())
    first = open_.select(
        (4 * k).alias(SEQ),
        k.alias("reservation_id"),
        F.when(k % 13 == 0, F.col("CheckIn") - _days_hours(0, 1))
        .otherwise(F.col("CheckIn") + _days_hours(1 + k % 5, k % 24))
        .alias("check_out"),
    )
    second = open_.where(k % 3 == 0).select(
        (4 * k + 1).alias(SEQ), k.alias("reservation_id"), (F.col("CheckIn") + _days_hours(2 + k % 3, 0)).alias("check_out")
    )
    unknown = open_.where(k % 7 == 0).select(
        (4 * k + 2).alias(SEQ), (-k).alias("reservation_id"), (F.col("CheckIn") + _days_hours(1, 0)).alias("check_out")
    )
    default = open_.where(k % 11 == 0).select(
        (4 * k + 3).alias(SEQ), k.alias("reservation_id"), F.lit(None).cast(TS).alias("check_out")
    )
    # a bill of millions of nights, which AmountPayable can't hold
    far = open_.where((k % 7 != 0) & (k % 5 == 0)).select(
        (4 * k + 2).alias(SEQ), k.alias("reservation_id"), F.lit("9999-01-01 10:00:00").cast(TS).alias("check_out")
    )
    rebill = r.where(F.col("CheckOut").isNotNull()).select(
        (4 * k).alias(SEQ), k.alias("reservation_id"), (F.col("CheckOut") + _days_hours(1, 0)).alias("check_out")
    )
    return first.unionByName(second).unionByName(unknown).unionByName(default).unionByName(far).unionByName(rebill)


_CHECKOUT_SQL = f"""
WITH feed AS (
  SELECT 4 * ReservationID AS change_seq, ReservationID AS reservation_id,
         CASE WHEN ReservationID % 13 = 0 THEN CheckIn - INTERVAL 1 HOUR
              ELSE CheckIn + to_days(CAST(1 + ReservationID % 5 AS INTEGER)) + to_hours(ReservationID % 24) END
           AS check_out
  FROM hotel_reservation WHERE CheckOut IS NULL
  UNION ALL
  SELECT 4 * ReservationID + 1, ReservationID, CheckIn + to_days(CAST(2 + ReservationID % 3 AS INTEGER))
  FROM hotel_reservation WHERE CheckOut IS NULL AND ReservationID % 3 = 0
  UNION ALL
  SELECT 4 * ReservationID + 2, -ReservationID, CheckIn + INTERVAL 1 DAY
  FROM hotel_reservation WHERE CheckOut IS NULL AND ReservationID % 7 = 0
  UNION ALL
  SELECT 4 * ReservationID + 3, ReservationID, CAST(NULL AS TIMESTAMP)
  FROM hotel_reservation WHERE CheckOut IS NULL AND ReservationID % 11 = 0
  UNION ALL
  SELECT 4 * ReservationID + 2, ReservationID, TIMESTAMP '9999-01-01 10:00:00'
  FROM hotel_reservation WHERE CheckOut IS NULL AND ReservationID % 7 <> 0 AND ReservationID % 5 = 0
  UNION ALL
  SELECT 4 * ReservationID, ReservationID, CheckOut + INTERVAL 1 DAY
  FROM hotel_reservation WHERE CheckOut IS NOT NULL),
timed AS (SELECT *, COALESCE(check_out, TIMESTAMP '{CHECKOUT_AS_OF}') AS new_out FROM feed),
priced AS (
  SELECT t.*, r.ReservationID AS stay, r.RoomID, r.CustomerID, r.CheckIn,
         {O.charge_sql(O.nights_sql('r.CheckIn', 't.new_out'), 'rm.RoomRate')} AS charge
  FROM timed t LEFT JOIN hotel_reservation r ON r.ReservationID = t.reservation_id
  LEFT JOIN hotel_room rm ON rm.RoomNo = r.RoomID),
judged AS (
  SELECT *, CASE WHEN stay IS NULL THEN 'not found'
                 WHEN new_out <= CheckIn THEN '{C.STAY_ORDER}'
                 WHEN charge IS NULL THEN 'size: AmountPayable' END AS reason
  FROM priced),
winners AS (
  SELECT * FROM judged WHERE reason IS NULL
  QUALIFY row_number() OVER (PARTITION BY reservation_id ORDER BY change_seq DESC) = 1),
bills AS (SELECT reservation_id, CustomerID, change_seq, charge FROM winners)
"""


def _checkout(c: Context):
    return C.checkout_and_bill(c.T, checkout_feed(c.T), CHECKOUT_AS_OF)


register("checkout_stays", _CHECKOUT_SQL + f"""
SELECT r.ReservationID, r.RoomID, r.CustomerID, r.StaffID, r.CheckIn,
       CASE WHEN w.reservation_id IS NULL THEN r.CheckOut ELSE w.new_out END AS CheckOut
FROM hotel_reservation r LEFT JOIN winners w ON w.reservation_id = r.ReservationID
""")(lambda c: _checkout(c)[0]["reservation"])

register("checkout_rooms", _CHECKOUT_SQL + """
SELECT rm.RoomNo, rm.RoomType, rm.RoomRate,
       CASE WHEN rm.RoomNo IN (SELECT RoomID FROM winners) THEN 'Vacant' ELSE rm.RoomStatus END AS RoomStatus,
       rm.HousekeeperID
FROM hotel_room rm
""")(lambda c: _checkout(c)[0]["room"])

register("checkout_invoices", _CHECKOUT_SQL + """
SELECT i.InvoiceNo, i.ReservationID, i.CustomerID, COALESCE(b.charge, i.AmountPayable) AS AmountPayable, i.AmountPaid
FROM hotel_invoice i LEFT JOIN bills b ON b.reservation_id = i.ReservationID
UNION ALL
SELECT (SELECT max(InvoiceNo) FROM hotel_invoice) + b.change_seq, b.reservation_id, b.CustomerID, b.charge,
       CAST(0 AS DECIMAL(10,2))
FROM bills b
WHERE b.reservation_id NOT IN (SELECT ReservationID FROM hotel_invoice WHERE ReservationID IS NOT NULL)
""")(lambda c: _checkout(c)[0]["invoice"])

register("checkout_rejects", _CHECKOUT_SQL + """
SELECT change_seq, reservation_id, check_out, reason FROM judged WHERE reason IS NOT NULL
""")(lambda c: _checkout(c)[1])


# ================================================================ I12 payments

def payment_feed(T) -> DataFrame:
    k = F.col("ReservationID")  # every order key; invoices exist for key % 4 <> 0
    r = T["reservation"]
    first = r.select(
        (2 * k).alias(SEQ), k.alias("invoice_no"), ((k % 7) * 10).cast("decimal(10,2)").alias("amount")
    )
    second = r.where(k % 6 == 0).select(
        (2 * k + 1).alias(SEQ), k.alias("invoice_no"), F.lit("5.25").cast("decimal(10,2)").alias("amount")
    )
    return first.unionByName(second)


_PAYMENT_SQL = f"""
WITH feed AS (
  SELECT 2 * ReservationID AS change_seq, ReservationID AS invoice_no,
         CAST((ReservationID % 7) * 10 AS DECIMAL(10,2)) AS amount
  FROM hotel_reservation
  UNION ALL
  SELECT 2 * ReservationID + 1, ReservationID, CAST(5.25 AS DECIMAL(10,2))
  FROM hotel_reservation WHERE ReservationID % 6 = 0),
judged AS (
  SELECT f.*, CASE WHEN f.amount IS NULL OR f.amount <= 0 THEN '{C.BAD_PAYMENT}'
                   WHEN i.InvoiceNo IS NULL THEN 'not found' END AS reason
  FROM feed f LEFT JOIN hotel_invoice i ON i.InvoiceNo = f.invoice_no),
totals AS (
  SELECT i.InvoiceNo, i.AmountPaid + t.paid AS new_paid
  FROM (SELECT invoice_no, sum(amount) AS paid FROM judged WHERE reason IS NULL GROUP BY invoice_no) t
  JOIN hotel_invoice i ON i.InvoiceNo = t.invoice_no)
"""


def _payments(c: Context):
    return C.record_payments(c.T, payment_feed(c.T))


register("payment_invoices", _PAYMENT_SQL + """
SELECT i.InvoiceNo, i.ReservationID, i.CustomerID, i.AmountPayable,
       CASE WHEN t.new_paid IS NOT NULL AND abs(t.new_paid) < 100000000
            THEN CAST(t.new_paid AS DECIMAL(10,2)) ELSE i.AmountPaid END AS AmountPaid
FROM hotel_invoice i LEFT JOIN totals t ON t.InvoiceNo = i.InvoiceNo
""")(lambda c: _payments(c)[0]["invoice"])

register("payment_rejects", _PAYMENT_SQL + """
SELECT j.change_seq, j.invoice_no, j.amount, COALESCE(j.reason, 'size: AmountPaid') AS reason
FROM judged j LEFT JOIN totals t ON t.InvoiceNo = j.invoice_no
WHERE j.reason IS NOT NULL OR abs(t.new_paid) >= 100000000
""")(lambda c: _payments(c)[1])


# ============================================================ I9 booking requests

def request_feed(T) -> DataFrame:
    cu = T["customer"]
    k = F.col("CustomerID")
    check_in = F.lit("2024-02-01 14:00:00").cast(TS) + _days_hours(k % 30, 0)
    check_out = check_in + _days_hours(k % 4, 0)
    room_type = F.concat(F.lit("Suite "), (k % 3).cast("string"))
    unseen_phone = F.concat(F.lit("1"), F.lpad(k.cast("string"), 9, "0"))
    new_guest = k % 7 == 1  # every seventh customer writes in from a new phone
    first = cu.select(
        (2 * k).alias(SEQ),
        F.when(new_guest, F.concat(F.lit(" New"), k.cast("string")))
        .when(k % 19 == 0, F.lit(" "))
        .otherwise(F.col("CustomerFName"))
        .alias("fname"),
        F.col("CustomerLName").alias("lname"),
        F.when(new_guest, unseen_phone).otherwise(F.col("PhoneNumber")).alias("phone"),
        room_type.alias("room_type"),
        check_in.alias("check_in"),
        F.when(new_guest, check_in + _days_hours(2, 0)).otherwise(check_out).alias("check_out"),
    )
    again = cu.where(k % 14 == 1).select(
        (2 * k + 1).alias(SEQ),
        F.concat(F.lit("Again"), k.cast("string")).alias("fname"),
        F.lit("Guest").alias("lname"),
        unseen_phone.alias("phone"),
        room_type.alias("room_type"),
        check_in.alias("check_in"),
        (check_in + _days_hours(1, 0)).alias("check_out"),
    )
    return first.unionByName(again)


_REQUEST_SQL = f"""
WITH feed AS (
  SELECT 2 * CustomerID AS change_seq,
         CASE WHEN CustomerID % 7 = 1 THEN ' New' || CAST(CustomerID AS VARCHAR)
              WHEN CustomerID % 19 = 0 THEN ' ' ELSE CustomerFName END AS fname,
         CustomerLName AS lname,
         CASE WHEN CustomerID % 7 = 1 THEN '1' || lpad(CAST(CustomerID AS VARCHAR), 9, '0') ELSE PhoneNumber END
           AS phone,
         'Suite ' || CAST(CustomerID % 3 AS VARCHAR) AS room_type,
         TIMESTAMP '2024-02-01 14:00:00' + to_days(CAST(CustomerID % 30 AS INTEGER)) AS check_in,
         TIMESTAMP '2024-02-01 14:00:00' + to_days(CAST(CustomerID % 30 AS INTEGER))
           + CASE WHEN CustomerID % 7 = 1 THEN INTERVAL 2 DAY ELSE to_days(CAST(CustomerID % 4 AS INTEGER)) END
           AS check_out
  FROM hotel_customer
  UNION ALL
  SELECT 2 * CustomerID + 1, 'Again' || CAST(CustomerID AS VARCHAR), 'Guest',
         '1' || lpad(CAST(CustomerID AS VARCHAR), 9, '0'), 'Suite ' || CAST(CustomerID % 3 AS VARCHAR),
         TIMESTAMP '2024-02-01 14:00:00' + to_days(CAST(CustomerID % 30 AS INTEGER)),
         TIMESTAMP '2024-02-01 14:00:00' + to_days(CAST(CustomerID % 30 AS INTEGER)) + INTERVAL 1 DAY
  FROM hotel_customer WHERE CustomerID % 14 = 1),
cleaned AS (
  SELECT feed.*, trim(COALESCE(fname, '')) AS f, trim(COALESCE(lname, '')) AS l, trim(COALESCE(phone, '')) AS p,
         'AK-' || {_base36_sql('change_seq')} AS token
  FROM feed),
judged AS (
  SELECT cleaned.*,
         CASE WHEN room_type IS NULL OR room_type = '' OR check_in IS NULL OR check_out IS NULL
                   OR f = '' OR l = '' OR p = '' THEN '{C.MISSING}'
              WHEN check_out <= check_in THEN '{C.REQUEST_ORDER}'
              WHEN length(room_type) > 30 THEN 'size: RoomType'
              WHEN length(f) > 20 THEN 'size: CustomerFName'
              WHEN length(l) > 20 THEN 'size: CustomerLName'
              WHEN length(p) > 10 THEN 'size: PhoneNumber'
              WHEN token IN (SELECT RequestToken FROM hotel_reservation_request) THEN 'duplicate key' END AS reason
  FROM cleaned),
valid AS (SELECT * FROM judged WHERE reason IS NULL),
known AS (SELECT PhoneNumber, min(CustomerID) AS cid FROM hotel_customer GROUP BY PhoneNumber),
made AS (
  SELECT p, arg_min(f, change_seq) AS f, arg_min(l, change_seq) AS l,
         (SELECT max(CustomerID) FROM hotel_customer) + min(change_seq) AS cid
  FROM valid WHERE p NOT IN (SELECT PhoneNumber FROM hotel_customer) GROUP BY p)
"""


def _requests(c: Context):
    return C.submit_requests(c.T, request_feed(c.T), AS_OF)


register("request_submissions", _REQUEST_SQL + f"""
SELECT {_REQ_COLS} FROM hotel_reservation_request
UNION ALL
SELECT v.token, COALESCE(k.cid, m.cid), v.room_type, v.check_in, v.check_out, 'Pending', NULL, NULL, DATE '{AS_OF}'
FROM valid v LEFT JOIN known k ON k.PhoneNumber = v.p LEFT JOIN made m ON m.p = v.p
""")(lambda c: _requests(c)[0]["reservation_request"])

register("request_customers", _REQUEST_SQL + """
SELECT CustomerID, CustomerFName, CustomerLName, PhoneNumber FROM hotel_customer
UNION ALL
SELECT cid, f, l, p FROM made
""")(lambda c: _requests(c)[0]["customer"])

register("request_rejects", _REQUEST_SQL + """
SELECT change_seq, fname, lname, phone, room_type, check_in, check_out, reason FROM judged WHERE reason IS NOT NULL
""")(lambda c: _requests(c)[1])


def _second_requests(c: Context):
    """The same requests sent again as a new batch whose numbers start over."""
    after = {**c.T, **_requests(c)[0]}
    return C.submit_requests(after, request_feed(c.T), AS_OF)


register("request_second_batch", _REQUEST_SQL.rstrip() + f""",
asked AS (
  SELECT v.*, COALESCE(k.cid, m.cid) AS cid FROM valid v
  LEFT JOIN known k ON k.PhoneNumber = v.p LEFT JOIN made m ON m.p = v.p),
numbered AS (
  SELECT 0 AS batch, *, change_seq AS number FROM asked
  UNION ALL SELECT 1, *, change_seq + (SELECT max(change_seq) FROM asked) FROM asked)
SELECT {_REQ_COLS} FROM hotel_reservation_request
UNION ALL
SELECT 'AK-' || {_base36_sql('number')}, cid, room_type, check_in, check_out, 'Pending', NULL, NULL, DATE '{AS_OF}'
FROM numbered
""")(lambda c: _second_requests(c)[0]["reservation_request"])


def token_feed(T) -> DataFrame:
    """The requests with a token in the form of made ones that leaves no room, a taken, an own or no token."""
    n = F.col(SEQ)
    taken = F.concat(F.lit("RQ-"), F.floor(n / 2) * 5)
    token = F.when(n % 22 == 8, "AK-ZZZZZZZZZZZZ").when(n % 22 == 10, F.concat(F.lit("AK-ZZZZZZZZZZZZ"), n)).when(n % 22 == 12, taken)
    return request_feed(T).withColumn("token", token.when(n % 22 == 14, F.concat(F.lit("G-"), F.floor(n / 44).cast("string"))))


_TOKEN_SQL = _REQUEST_SQL.replace(
    f"'AK-' || {_base36_sql('change_seq')} AS token",
    f"""CASE change_seq % 22 WHEN 8 THEN 'AK-ZZZZZZZZZZZZ' WHEN 10 THEN 'AK-ZZZZZZZZZZZZ' || change_seq
             WHEN 12 THEN 'RQ-' || (change_seq // 2 * 5) WHEN 14 THEN 'G-' || (change_seq // 44) END AS given,
         COALESCE(given, 'AK-' || {_base36_sql('change_seq')}) AS token""",
).replace("WHEN token IN (SELECT", "WHEN change_seq % 22 IN (8, 10) THEN 'size: RequestToken'\n              WHEN token IN (SELECT").replace(
    "'duplicate key' END AS reason\n  FROM cleaned),", """'duplicate key' END AS reason0
  FROM cleaned),
once AS (
  SELECT *, CASE WHEN reason0 IS NULL AND change_seq <> min(CASE WHEN reason0 IS NULL THEN change_seq END) OVER (PARTITION BY token)
                 THEN 'duplicate key' ELSE reason0 END AS reason
  FROM judged),"""
).replace("FROM judged WHERE reason IS NULL", "FROM once WHERE reason IS NULL")


register("given_token_requests", _TOKEN_SQL + f"""
SELECT {_REQ_COLS} FROM hotel_reservation_request
UNION ALL
SELECT v.token, COALESCE(k.cid, m.cid), v.room_type, v.check_in, v.check_out, 'Pending', NULL, NULL, DATE '{AS_OF}'
FROM valid v LEFT JOIN known k ON k.PhoneNumber = v.p LEFT JOIN made m ON m.p = v.p
""")(lambda c: C.submit_requests(c.T, token_feed(c.T), AS_OF)[0]["reservation_request"])

register("given_token_rejects", _TOKEN_SQL + """
SELECT change_seq, fname, lname, phone, room_type, check_in, check_out, given AS token, reason FROM once WHERE reason IS NOT NULL
""")(lambda c: C.submit_requests(c.T, token_feed(c.T), AS_OF)[1])


# ===================================================== I10 + I11 request decisions

def _token_key(col: str = "RequestToken"):
    return F.substring(F.col(col), 4, 30).cast("bigint")


def decision_feeds(T) -> tuple[DataFrame, DataFrame]:
    rq = T["reservation_request"].withColumn("__k", _token_key())
    k = F.col("__k")
    # the reference UI offers the cheapest vacant room of the type first
    vacant = (
        T["room"].where(F.col("RoomStatus") == "Vacant")
        .groupBy("RoomType")
        .agg(F.min(F.struct("RoomRate", "RoomNo")).alias("m"))
        .select("RoomType", F.col("m.RoomNo").alias("__room"))
    )
    pending = rq.where(F.col("Status") == "Pending").join(vacant, "RoomType", "left")
    approvals = pending.select(
        (2 * k).alias(SEQ),
        F.col("RequestToken").alias("token"),
        F.col("__room").cast("string").alias("room_no"),
        (2 * (k % 7)).cast("string").alias("staff_id"),
    ).unionByName(
        rq.where((F.col("Status") == "Approved") & (k % 11 == 0)).select(
            (2 * k).alias(SEQ),
            F.col("RequestToken").alias("token"),
            F.col("RoomNo").cast("string").alias("room_no"),
            F.lit("2").alias("staff_id"),
        )
    )
    declines = rq.where((F.col("Status") == "Pending") & (k % 7 == 0)).select(
        F.when(k % 2 == 0, 2 * k - 1).otherwise(2 * k + 1).alias(SEQ),
        F.col("RequestToken").alias("token"),
        F.lit("4").alias("staff_id"),
    )
    return approvals, declines


_DECISION_SQL = f"""
WITH rq AS (SELECT *, CAST(substr(RequestToken, 4) AS BIGINT) AS k FROM hotel_reservation_request),
vacant AS (
  SELECT RoomType, RoomNo FROM hotel_room WHERE RoomStatus = 'Vacant'
  QUALIFY row_number() OVER (PARTITION BY RoomType ORDER BY RoomRate, RoomNo) = 1),
feed AS (
  SELECT 'approve' AS kind, 2 * k AS change_seq, RequestToken AS token, CAST(v.RoomNo AS VARCHAR) AS room_no,
         CAST(2 * (k % 7) AS VARCHAR) AS staff_id
  FROM rq LEFT JOIN vacant v ON v.RoomType = rq.RoomType WHERE rq.Status = 'Pending'
  UNION ALL
  SELECT 'approve', 2 * k, RequestToken, CAST(RoomNo AS VARCHAR), '2' FROM rq WHERE Status = 'Approved' AND k % 11 = 0
  UNION ALL
  SELECT 'decline', CASE WHEN k % 2 = 0 THEN 2 * k - 1 ELSE 2 * k + 1 END, RequestToken, NULL, '4'
  FROM rq WHERE Status = 'Pending' AND k % 7 = 0),
looked AS (
  SELECT f.*, q.Status AS cur, q.CustomerID, q.CheckIn, q.CheckOut,
         TRY_CAST(f.room_no AS BIGINT) AS room_id, TRY_CAST(f.staff_id AS BIGINT) AS staff
  FROM feed f LEFT JOIN hotel_reservation_request q ON q.RequestToken = f.token),
judged AS (
  SELECT looked.*,
         CASE WHEN kind = 'approve' AND (room_no IS NULL OR room_no = '') THEN 'room_no is required'
              WHEN staff_id IS NULL OR staff_id = '' THEN 'staff_id is required'
              WHEN cur IS NULL THEN 'not found'
              WHEN cur <> 'Pending' THEN '{C.ALREADY}' || lower(cur) || '.' END AS pre,
         CASE WHEN kind = 'approve' AND (room_id IS NULL OR room_id NOT IN (SELECT RoomNo FROM hotel_room))
                THEN 'foreign_key: RoomID'
              WHEN staff IS NULL OR staff NOT IN (SELECT StaffID FROM hotel_frontdesk) THEN 'foreign_key: StaffID'
              WHEN kind = 'approve' AND CheckOut <= CheckIn THEN '{C.STAY_ORDER}' END AS post
  FROM looked),
firsts AS (
  SELECT token, arg_min(kind, change_seq) AS wkind, min(change_seq) AS first_seq
  FROM judged WHERE pre IS NULL AND post IS NULL GROUP BY token),
final AS (
  SELECT j.*, COALESCE(j.pre,
                       CASE WHEN j.change_seq > f.first_seq
                            THEN '{C.ALREADY}' || CASE WHEN f.wkind = 'approve' THEN 'approved' ELSE 'declined' END || '.'
                       END,
                       j.post) AS reason
  FROM judged j LEFT JOIN firsts f ON f.token = j.token),
won AS (SELECT * FROM final WHERE reason IS NULL)
"""


def _decisions(c: Context):
    approvals, declines = decision_feeds(c.T)
    return C.decide_requests(c.T, approvals, declines)


register("decision_requests", _DECISION_SQL + """
SELECT q.RequestToken, q.CustomerID, q.RoomType, q.CheckIn, q.CheckOut,
       CASE WHEN w.kind = 'approve' THEN 'Approved' WHEN w.kind = 'decline' THEN 'Declined' ELSE q.Status END AS Status,
       CASE WHEN w.kind = 'approve' THEN w.room_id WHEN w.kind = 'decline' THEN NULL ELSE q.RoomNo END AS RoomNo,
       CASE WHEN w.kind IS NOT NULL THEN w.staff ELSE q.StaffID END AS StaffID,
       q.RequestDate
FROM hotel_reservation_request q LEFT JOIN won w ON w.token = q.RequestToken
""")(lambda c: _decisions(c)[0]["reservation_request"])

register("decision_stays", _DECISION_SQL + f"""
SELECT {_RES_COLS} FROM hotel_reservation
UNION ALL
SELECT (SELECT max(ReservationID) FROM hotel_reservation) + change_seq, room_id, CustomerID, staff, CheckIn, CheckOut
FROM won WHERE kind = 'approve'
""")(lambda c: _decisions(c)[0]["reservation"])

register("decision_rooms", _DECISION_SQL + """
SELECT rm.RoomNo, rm.RoomType, rm.RoomRate,
       CASE WHEN rm.RoomNo IN (SELECT room_id FROM won WHERE kind = 'approve') THEN 'Vacant' ELSE rm.RoomStatus END
         AS RoomStatus,
       rm.HousekeeperID
FROM hotel_room rm
""")(lambda c: _decisions(c)[0]["room"])

register("decision_rejects", _DECISION_SQL + """
SELECT kind, change_seq, token, room_no, staff_id, reason FROM final WHERE reason IS NOT NULL
""")(lambda c: _decisions(c)[1])


# ================================================================= I4 bookings

def booking_feed(T) -> DataFrame:
    r = T["reservation"]
    k = F.col("ReservationID")
    check_in = F.col("CheckIn") + _days_hours(30, 0)
    return r.select(
        k.alias(SEQ),
        F.lit(None).cast("bigint").alias("reservation_id"),
        F.when(k % 39 == 0, -k).otherwise(F.col("RoomID")).alias("room_id"),
        F.col("CustomerID").alias("customer_id"),
        F.when(k % 50 == 0, F.lit(0).cast("bigint")).otherwise(F.col("StaffID")).alias("staff_id"),
        check_in.alias("check_in"),
        F.when(k % 2 == 0, F.lit(None).cast(TS))
        .when(k % 5 == 0, check_in - _days_hours(0, 1))
        .otherwise(check_in + _days_hours(2, 0))
        .alias("check_out"),
    )


_BOOKING_SQL = f"""
WITH feed AS (
  SELECT ReservationID AS change_seq, CAST(NULL AS BIGINT) AS reservation_id,
         CASE WHEN ReservationID % 39 = 0 THEN -ReservationID ELSE RoomID END AS room_id,
         CustomerID AS customer_id,
         CASE WHEN ReservationID % 50 = 0 THEN CAST(0 AS BIGINT) ELSE StaffID END AS staff_id,
         CheckIn + INTERVAL 30 DAY AS check_in,
         CASE WHEN ReservationID % 2 = 0 THEN CAST(NULL AS TIMESTAMP)
              WHEN ReservationID % 5 = 0 THEN CheckIn + INTERVAL 30 DAY - INTERVAL 1 HOUR
              ELSE CheckIn + INTERVAL 32 DAY END AS check_out
  FROM hotel_reservation),
judged AS (
  SELECT feed.*, (SELECT max(ReservationID) FROM hotel_reservation) + change_seq AS new_id,
         CASE WHEN room_id IS NULL OR room_id = 0 OR customer_id IS NULL OR customer_id = 0
                   OR check_in IS NULL OR staff_id IS NULL OR staff_id = 0 THEN '{C.MISSING}'
              WHEN check_out IS NOT NULL AND check_out <= check_in THEN '{C.STAY_ORDER}'
              WHEN (SELECT max(ReservationID) FROM hotel_reservation) + change_seq
                   IN (SELECT ReservationID FROM hotel_reservation) THEN 'duplicate key'
              WHEN room_id NOT IN (SELECT RoomNo FROM hotel_room) THEN 'foreign_key: RoomID'
              WHEN customer_id NOT IN (SELECT CustomerID FROM hotel_customer) THEN 'foreign_key: CustomerID'
              WHEN staff_id NOT IN (SELECT StaffID FROM hotel_frontdesk) THEN 'foreign_key: StaffID' END AS reason
  FROM feed)
"""


def _bookings(c: Context):
    return C.book_stays(c.T, booking_feed(c.T))


register("booking_stays", _BOOKING_SQL + f"""
SELECT {_RES_COLS} FROM hotel_reservation
UNION ALL
SELECT new_id, room_id, customer_id, staff_id, check_in, check_out FROM judged WHERE reason IS NULL
""")(lambda c: _bookings(c)[0]["reservation"])

register("booking_rooms", _BOOKING_SQL + """
SELECT RoomNo, RoomType, RoomRate,
       CASE WHEN RoomNo IN (SELECT room_id FROM judged WHERE reason IS NULL) THEN 'Occupied' ELSE RoomStatus END
         AS RoomStatus,
       HousekeeperID
FROM hotel_room
""")(lambda c: _bookings(c)[0]["room"])

register("booking_rejects", _BOOKING_SQL + """
SELECT change_seq, reservation_id, room_id, customer_id, staff_id, check_in, check_out, reason
FROM judged WHERE reason IS NOT NULL
""")(lambda c: _bookings(c)[1])


# ================================================= I7 room status from all stays

_REPLAYED_SQL = """
WITH last_stay AS (
  SELECT RoomID, CheckOut FROM hotel_reservation
  QUALIFY row_number() OVER (PARTITION BY RoomID ORDER BY ReservationID DESC) = 1)
SELECT rm.RoomNo, rm.RoomType, rm.RoomRate,
       CASE WHEN l.RoomID IS NULL THEN rm.RoomStatus WHEN l.CheckOut IS NULL THEN 'Occupied' ELSE 'Vacant' END
         AS RoomStatus,
       rm.HousekeeperID
FROM hotel_room rm LEFT JOIN last_stay l ON l.RoomID = rm.RoomNo
"""


@register("replayed_room_status", _REPLAYED_SQL)
def _replayed_room_status(c: Context) -> DataFrame:
    # every stay insert replayed in key order: the trigger's last write per room wins
    stays = c.T["reservation"].select("RoomID", "CheckOut", F.col("ReservationID").alias(SEQ))
    return C.derive_room_status(c.T["room"], stays)


@register("streamed_room_status", _REPLAYED_SQL)
def _streamed_room_status(c: Context) -> DataFrame:
    """K: the same stays as a stream of files, a micro-batch each; changed rooms go to a log, compacted on the way."""
    folder = new_folder(c.spark, "room-status")
    stays = c.T["reservation"].select("RoomID", "CheckOut", F.col("ReservationID").alias(SEQ))
    stays.repartition(3, F.col(SEQ)).write.parquet(f"{folder}/stays")
    log = room_status.room_log(f"{folder}/rooms")
    log.create(c.T["room"])
    files = c.spark.readStream.schema(stays.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/stays")
    query = room_status.start(files, log, f"{folder}/checkpoint", {"availableNow": True}, compact_every=2)
    query.awaitTermination()
    return log.read(c.spark)


# ============================================================ I8 room status set

def room_status_feed(T) -> DataFrame:
    rm = T["room"]
    k = F.col("RoomNo")
    a = rm.select(
        (2 * k).alias(SEQ), k.alias("room_no"), F.when(k % 2 == 0, "Vacant").otherwise("Occupied").alias("status")
    )
    b = rm.where(k % 27 == 0).select((2 * k + 1).alias(SEQ), k.alias("room_no"), F.lit("Cleaning").alias("status"))
    return a.unionByName(b)


_ROOM_STATUS_SQL = f"""
WITH feed AS (
  SELECT 2 * RoomNo AS change_seq, RoomNo AS room_no,
         CASE WHEN RoomNo % 2 = 0 THEN 'Vacant' ELSE 'Occupied' END AS status
  FROM hotel_room
  UNION ALL
  SELECT 2 * RoomNo + 1, RoomNo, 'Cleaning' FROM hotel_room WHERE RoomNo % 27 = 0),
judged AS (
  SELECT feed.*, CASE WHEN status IS NULL OR status NOT IN ('Occupied', 'Vacant') THEN '{C.BAD_STATUS.replace("'", "''")}'
                      WHEN room_no NOT IN (SELECT RoomNo FROM hotel_room) THEN 'not found' END AS reason
  FROM feed),
last AS (
  SELECT * FROM judged WHERE reason IS NULL
  QUALIFY row_number() OVER (PARTITION BY room_no ORDER BY change_seq DESC) = 1)
"""

register("room_status_updates", _ROOM_STATUS_SQL + """
SELECT rm.RoomNo, rm.RoomType, rm.RoomRate, COALESCE(l.status, rm.RoomStatus) AS RoomStatus, rm.HousekeeperID
FROM hotel_room rm LEFT JOIN last l ON l.room_no = rm.RoomNo
""")(lambda c: C.set_room_status(c.T, room_status_feed(c.T))[0]["room"])

register("room_status_rejects", _ROOM_STATUS_SQL + """
SELECT change_seq, room_no, status, reason FROM judged WHERE reason IS NOT NULL
""")(lambda c: C.set_room_status(c.T, room_status_feed(c.T))[1])


# ================================================================ I6 stay deletes

def stay_delete_feed(T) -> DataFrame:
    r = T["reservation"]
    k = F.col("ReservationID")
    a = r.select((4 * k).alias(SEQ), k.alias("reservation_id"))
    b = r.where(k % 22 == 0).select((4 * k + 1).alias(SEQ), (-k).alias("reservation_id"))
    again = r.where(k % 33 == 0).select((4 * k + 2).alias(SEQ), k.alias("reservation_id"))  # asked twice
    return a.unionByName(b).unionByName(again)


_STAY_DELETE_SQL = f"""
WITH feed AS (
  SELECT 4 * ReservationID AS change_seq, ReservationID AS reservation_id FROM hotel_reservation
  UNION ALL
  SELECT 4 * ReservationID + 1, -ReservationID FROM hotel_reservation WHERE ReservationID % 22 = 0
  UNION ALL
  SELECT 4 * ReservationID + 2, ReservationID FROM hotel_reservation WHERE ReservationID % 33 = 0),
judged AS (
  SELECT f.*, CASE WHEN r.ReservationID IS NULL THEN 'not found'
                   WHEN r.CheckOut IS NOT NULL THEN '{C.COMPLETED_DELETE}'
                   WHEN f.change_seq <> min(f.change_seq) OVER (PARTITION BY f.reservation_id) THEN 'not found'
              END AS reason
  FROM feed f LEFT JOIN hotel_reservation r ON r.ReservationID = f.reservation_id),
gone AS (SELECT DISTINCT reservation_id FROM judged WHERE reason IS NULL)
"""


def _stay_deletes(c: Context):
    return C.delete_stays(c.T, stay_delete_feed(c.T))


register("stay_delete_stays", _STAY_DELETE_SQL + f"""
SELECT {_RES_COLS} FROM hotel_reservation WHERE ReservationID NOT IN (SELECT reservation_id FROM gone)
""")(lambda c: _stay_deletes(c)[0]["reservation"])

register("stay_delete_invoices", _STAY_DELETE_SQL + """
SELECT InvoiceNo, CASE WHEN ReservationID IN (SELECT reservation_id FROM gone) THEN NULL ELSE ReservationID END
         AS ReservationID,
       CustomerID, AmountPayable, AmountPaid
FROM hotel_invoice
""")(lambda c: _stay_deletes(c)[0]["invoice"])

register("stay_delete_rejects", _STAY_DELETE_SQL + """
SELECT change_seq, reservation_id, reason FROM judged WHERE reason IS NOT NULL
""")(lambda c: _stay_deletes(c)[1])


# ============================================================ I15 staff removal

def staff_removal_feed(T) -> DataFrame:
    k = F.col("StaffID")
    # every fifth removal names nobody: rows of every table stay
    return T["staff"].select(k.alias(SEQ), F.when(k % 5 == 3, -k).otherwise(k).alias("staff_id"))


_STAFF_REMOVAL_SQL = f"""
WITH feed AS (SELECT StaffID AS change_seq, CASE WHEN StaffID % 5 = 3 THEN -StaffID ELSE StaffID END AS staff_id FROM hotel_staff),
judged AS (
  SELECT f.*, CASE WHEN s.StaffID IS NULL THEN 'not found'
                   WHEN f.staff_id IN (SELECT StaffID FROM hotel_reservation) THEN '{C.REFERENCED}reservation.StaffID'
                   WHEN f.change_seq <> min(f.change_seq) OVER (PARTITION BY f.staff_id) THEN 'not found'
              END AS reason
  FROM feed f LEFT JOIN hotel_staff s ON s.StaffID = f.staff_id),
gone AS (SELECT staff_id FROM judged WHERE reason IS NULL)
"""


def _staff_removal(c: Context):
    return C.remove_staff(c.T, staff_removal_feed(c.T))


register("staff_removal_staff", _STAFF_REMOVAL_SQL + """
SELECT StaffID, StaffFName, StaffLName, StaffRole FROM hotel_staff WHERE StaffID NOT IN (SELECT staff_id FROM gone)
""")(lambda c: _staff_removal(c)[0]["staff"])

register("staff_removal_rooms", _STAFF_REMOVAL_SQL + """
SELECT RoomNo, RoomType, RoomRate, RoomStatus,
       CASE WHEN HousekeeperID IN (SELECT staff_id FROM gone) THEN NULL ELSE HousekeeperID END AS HousekeeperID
FROM hotel_room
""")(lambda c: _staff_removal(c)[0]["room"])

register("staff_removal_housekeeping", _STAFF_REMOVAL_SQL + """
SELECT StaffID, Shift, AssignedFloor FROM hotel_housekeeping WHERE StaffID NOT IN (SELECT staff_id FROM gone)
""")(lambda c: _staff_removal(c)[0]["housekeeping"])

register("staff_removal_frontdesk", _STAFF_REMOVAL_SQL + """
SELECT StaffID, Shift FROM hotel_frontdesk WHERE StaffID NOT IN (SELECT staff_id FROM gone)
""")(lambda c: _staff_removal(c)[0]["frontdesk"])

register("staff_removal_requests", _STAFF_REMOVAL_SQL + """
SELECT * EXCLUDE (StaffID), CASE WHEN StaffID NOT IN (SELECT staff_id FROM gone) THEN StaffID END AS StaffID
FROM hotel_reservation_request
""")(lambda c: _staff_removal(c)[0]["reservation_request"])

register("staff_removal_rejects", _STAFF_REMOVAL_SQL + """
SELECT change_seq, staff_id, reason FROM judged WHERE reason IS NOT NULL
""")(lambda c: _staff_removal(c)[1])


# ========================================================= I16 customer removal

def customer_removal_feed(T) -> DataFrame:
    k = F.col("CustomerID")
    return T["customer"].select(k.alias(SEQ), k.alias("customer_id"))


_CUSTOMER_CHILDREN = {"reservation": "CustomerID", "event": "Host", "invoice": "CustomerID", "restaurant_order": "CustomerID"}


def _next_customer(column: str) -> str:
    return f"(CASE WHEN {column} % 5 = 0 THEN {column} + 1 ELSE {column} END)"


_CUSTOMER_REMOVAL_SQL = f"""
WITH feed AS (SELECT CustomerID AS change_seq, CustomerID AS customer_id FROM hotel_customer),
judged AS (
  SELECT f.*, CASE WHEN c.CustomerID IS NULL THEN 'not found'
    WHEN f.customer_id IN (SELECT {_next_customer("CustomerID")} FROM hotel_reservation)
      THEN '{C.REFERENCED}reservation.CustomerID'
    WHEN f.customer_id IN (SELECT {_next_customer("Host")} FROM hotel_event) THEN '{C.REFERENCED}event.Host'
    WHEN f.customer_id IN (SELECT {_next_customer("CustomerID")} FROM hotel_invoice)
      THEN '{C.REFERENCED}invoice.CustomerID'
    WHEN f.customer_id IN (SELECT {_next_customer("CustomerID")} FROM hotel_restaurant_order)
      THEN '{C.REFERENCED}restaurant_order.CustomerID'
    WHEN f.change_seq <> min(f.change_seq) OVER (PARTITION BY f.customer_id) THEN 'not found' END AS reason
  FROM feed f LEFT JOIN hotel_customer c ON c.CustomerID = f.customer_id),
gone AS (SELECT customer_id FROM judged WHERE reason IS NULL)
"""


def _customer_removal(c: Context):
    # the stays, events, invoices and orders of every fifth customer are the next one's: these customers go, with what cascades
    moved = {t: c.T[t].withColumn(k, F.when(F.col(k) % 5 == 0, F.col(k) + 1).otherwise(F.col(k))) for t, k in _CUSTOMER_CHILDREN.items()}
    return C.remove_customers({**c.T, **moved}, customer_removal_feed(c.T))


register("customer_removal_customers", _CUSTOMER_REMOVAL_SQL + """
SELECT CustomerID, CustomerFName, CustomerLName, PhoneNumber FROM hotel_customer
WHERE CustomerID NOT IN (SELECT customer_id FROM gone)
""")(lambda c: _customer_removal(c)[0]["customer"])

register("customer_removal_feedback", _CUSTOMER_REMOVAL_SQL + """
SELECT FeedbackID, CustomerID, Rating, Comments, FeedbackDate FROM hotel_customer_feedback
WHERE CustomerID NOT IN (SELECT customer_id FROM gone)
""")(lambda c: _customer_removal(c)[0]["customer_feedback"])

register("customer_removal_requests", _CUSTOMER_REMOVAL_SQL + f"""
SELECT {_REQ_COLS} FROM hotel_reservation_request WHERE CustomerID NOT IN (SELECT customer_id FROM gone)
""")(lambda c: _customer_removal(c)[0]["reservation_request"])

register("customer_removal_rejects", _CUSTOMER_REMOVAL_SQL + """
SELECT change_seq, customer_id, reason FROM judged WHERE reason IS NOT NULL
""")(lambda c: _customer_removal(c)[1])


# ============================== deletes of other tables, by the schema's graph alone

def hall_removal_feed(T) -> DataFrame:
    k = F.col("HallID")
    return T["conference_hall"].select(k.alias(SEQ), F.when(k % 7 == 2, k - 1).otherwise(k).alias("hall_id"))


_HALL_REMOVAL_SQL = f"""
WITH feed AS (SELECT HallID AS change_seq, CASE WHEN HallID % 7 = 2 THEN HallID - 1 ELSE HallID END AS hall_id FROM hotel_conference_hall),
used AS (SELECT CASE WHEN HallID % 3 = 1 THEN HallID - 1 ELSE HallID END AS HallID FROM hotel_event),
judged AS (
  SELECT *, CASE WHEN hall_id NOT IN (SELECT HallID FROM hotel_conference_hall) THEN 'not found'
                 WHEN hall_id IN (SELECT HallID FROM used) THEN '{C.REFERENCED}event.HallID'
                 WHEN change_seq <> min(change_seq) OVER (PARTITION BY hall_id) THEN 'not found' END AS reason
  FROM feed)
"""


def _hall_removal(c: Context):
    # events of every third hall are held in the one before
    events = c.T["event"].withColumn("HallID", F.when(F.col("HallID") % 3 == 1, F.col("HallID") - 1).otherwise(F.col("HallID")))
    return C.remove_rows({**c.T, "event": events}, "conference_hall", hall_removal_feed(c.T), "hall_id")


register("hall_removals", _HALL_REMOVAL_SQL + """
SELECT HallID, HallName, Capacity FROM hotel_conference_hall WHERE HallID NOT IN (SELECT hall_id FROM judged WHERE reason IS NULL)
""")(lambda c: _hall_removal(c)[0]["conference_hall"])

register("hall_removal_rejects", _HALL_REMOVAL_SQL + """
SELECT change_seq, hall_id, reason FROM judged WHERE reason IS NOT NULL
""")(lambda c: _hall_removal(c)[1])


def _invoice_removal(c: Context):
    k = F.col("InvoiceNo")
    feed = c.T["invoice"].select(k.alias(SEQ), F.when(k % 4 == 1, -k).otherwise(k).alias("invoice_no"))
    return C.remove_rows(c.T, "invoice", feed, "invoice_no")[0]


register("invoice_removals", f"""
SELECT {_INV_COLS} FROM hotel_invoice WHERE InvoiceNo % 4 = 1
""")(lambda c: _invoice_removal(c)["invoice"])

register("invoice_removal_orders", """
SELECT * EXCLUDE (InvoiceID),
       CASE WHEN InvoiceID % 4 = 1 OR InvoiceID NOT IN (SELECT InvoiceNo FROM hotel_invoice) THEN InvoiceID END AS InvoiceID
FROM hotel_restaurant_order
""")(lambda c: _invoice_removal(c)["restaurant_order"])


# ==================================================== I2, I3 customers (add, edit)

def customer_add_feed(T) -> DataFrame:
    cu = T["customer"]
    k = F.col("CustomerID")
    a = cu.select(
        (4 * k).alias(SEQ),
        F.lit(None).cast("bigint").alias("customer_id"),
        F.when(k % 30 == 0, F.lit("")).otherwise(F.col("CustomerFName")).alias("fname"),
        F.lit("Copy").alias("lname"),
        F.col("PhoneNumber").alias("phone"),
    )
    b = cu.where(k % 20 == 0).select(
        (4 * k + 1).alias(SEQ), k.alias("customer_id"), F.lit("Dup").alias("fname"), F.lit("Row").alias("lname"),
        F.col("PhoneNumber").alias("phone"),
    )
    # ids that no made id could go on from
    far = cu.where(k % 25 == 3).select(
        (4 * k + 2).alias(SEQ), (F.lit(2**63 - 1) - k).alias("customer_id"), F.lit("Far").alias("fname"), F.lit("Away").alias("lname"),
        F.col("PhoneNumber").alias("phone"),
    )
    return a.unionByName(b).unionByName(far)


_CUSTOMER_ADD_SQL = f"""
WITH feed AS (
  SELECT 4 * CustomerID AS change_seq, CAST(NULL AS BIGINT) AS customer_id,
         CASE WHEN CustomerID % 30 = 0 THEN '' ELSE CustomerFName END AS fname, 'Copy' AS lname, PhoneNumber AS phone
  FROM hotel_customer
  UNION ALL
  SELECT 4 * CustomerID + 1, CustomerID, 'Dup', 'Row', PhoneNumber FROM hotel_customer WHERE CustomerID % 20 = 0
  UNION ALL
  SELECT 4 * CustomerID + 2, 9223372036854775807 - CustomerID, 'Far', 'Away', PhoneNumber FROM hotel_customer WHERE CustomerID % 25 = 3),
ided AS (
  SELECT feed.*, COALESCE(NULLIF(customer_id, 0), (SELECT max(CustomerID) FROM hotel_customer) + change_seq) AS new_id
  FROM feed),
judged AS (
  SELECT ided.*,
         CASE WHEN fname IS NULL OR fname = '' OR lname IS NULL OR lname = '' OR phone IS NULL OR phone = ''
                THEN '{C.MISSING}'
              WHEN length(fname) > 20 THEN 'size: CustomerFName'
              WHEN length(lname) > 20 THEN 'size: CustomerLName'
              WHEN length(phone) > 10 THEN 'size: PhoneNumber'
              WHEN customer_id >= {C.GIVEN_TOP} THEN 'size: CustomerID'
              WHEN new_id IN (SELECT CustomerID FROM hotel_customer) THEN 'duplicate key' END AS reason0
  FROM ided),
final AS (
  SELECT judged.*,
         CASE WHEN reason0 IS NULL
                   AND change_seq <> min(CASE WHEN reason0 IS NULL THEN change_seq END) OVER (PARTITION BY new_id)
              THEN 'duplicate key' ELSE reason0 END AS reason
  FROM judged)
"""

register("customer_additions", _CUSTOMER_ADD_SQL + """
SELECT CustomerID, CustomerFName, CustomerLName, PhoneNumber FROM hotel_customer
UNION ALL
SELECT new_id, fname, lname, phone FROM final WHERE reason IS NULL
""")(lambda c: C.add_customers(c.T, customer_add_feed(c.T))[0]["customer"])

register("customer_addition_rejects", _CUSTOMER_ADD_SQL + """
SELECT change_seq, customer_id, fname, lname, phone, reason FROM final WHERE reason IS NOT NULL
""")(lambda c: C.add_customers(c.T, customer_add_feed(c.T))[1])


def customer_edit_feed(T) -> DataFrame:
    cu = T["customer"]
    k = F.col("CustomerID")
    cols = lambda seq, cid, f, l: cu.select(seq.alias(SEQ), cid.alias("customer_id"), f.alias("fname"),
                                            l.alias("lname"), F.col("PhoneNumber").alias("phone"))
    return (
        cols(4 * k, k, F.lower("CustomerFName"), F.col("CustomerLName"))
        .unionByName(cols(4 * k + 1, k, F.lit("Zed"), F.lit(None).cast("string")).where(k % 30 == 5))
        .unionByName(cols(4 * k + 2, -k, F.lit("Ghost"), F.lit("Row")).where(k % 40 == 5))
        .unionByName(cols(4 * k + 3, k, F.lit("Late"), F.col("CustomerLName")).where(k % 20 == 5))
    )


_CUSTOMER_EDIT_SQL = f"""
WITH feed AS (
  SELECT 4 * CustomerID AS change_seq, CustomerID AS customer_id, lower(CustomerFName) AS fname,
         CustomerLName AS lname, PhoneNumber AS phone FROM hotel_customer
  UNION ALL SELECT 4 * CustomerID + 1, CustomerID, 'Zed', NULL, PhoneNumber FROM hotel_customer WHERE CustomerID % 30 = 5
  UNION ALL SELECT 4 * CustomerID + 2, -CustomerID, 'Ghost', 'Row', PhoneNumber FROM hotel_customer WHERE CustomerID % 40 = 5
  UNION ALL SELECT 4 * CustomerID + 3, CustomerID, 'Late', CustomerLName, PhoneNumber FROM hotel_customer
  WHERE CustomerID % 20 = 5),
judged AS (
  SELECT f.*, CASE WHEN c.CustomerID IS NULL THEN 'not found'
                   WHEN f.fname IS NULL THEN 'not_null: CustomerFName'
                   WHEN f.lname IS NULL THEN 'not_null: CustomerLName'
                   WHEN f.phone IS NULL THEN 'not_null: PhoneNumber'
                   WHEN length(f.fname) > 20 THEN 'size: CustomerFName'
                   WHEN length(f.lname) > 20 THEN 'size: CustomerLName'
                   WHEN length(f.phone) > 10 THEN 'size: PhoneNumber' END AS reason
  FROM feed f LEFT JOIN hotel_customer c ON c.CustomerID = f.customer_id),
last AS (
  SELECT * FROM judged WHERE reason IS NULL
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY change_seq DESC) = 1)
"""

register("customer_updates", _CUSTOMER_EDIT_SQL + """
SELECT c.CustomerID, COALESCE(l.fname, c.CustomerFName) AS CustomerFName,
       COALESCE(l.lname, c.CustomerLName) AS CustomerLName, COALESCE(l.phone, c.PhoneNumber) AS PhoneNumber
FROM hotel_customer c LEFT JOIN last l ON l.customer_id = c.CustomerID
""")(lambda c: C.update_customers(c.T, customer_edit_feed(c.T))[0]["customer"])

register("customer_update_rejects", _CUSTOMER_EDIT_SQL + """
SELECT change_seq, customer_id, fname, lname, phone, reason FROM judged WHERE reason IS NOT NULL
""")(lambda c: C.update_customers(c.T, customer_edit_feed(c.T))[1])


# ======================================================== I13 invoice creation

def invoice_feed(T) -> DataFrame:
    r = T["reservation"]
    k = F.col("ReservationID")
    pay = (100 + k % 50).cast("decimal(10,2)")

    def rows(seq, inv, res, cust, paid, src=r):
        return src.select(seq.alias(SEQ), inv.alias("invoice_no"), res.alias("reservation_id"),
                          cust.alias("customer_id"), pay.alias("amount_payable"), paid.alias("amount_paid"))

    # every stay that no invoice refers to gets one
    billed = T["invoice"].where(F.col("ReservationID").isNotNull()).select("ReservationID")
    unbilled = r.join(billed, "ReservationID", "left_anti")

    none = F.lit(None).cast("bigint")
    return (
        rows(4 * k, k, F.when(k % 8 != 0, k), F.col("CustomerID"),
             F.when(k % 3 == 0, (k % 50).cast("decimal(10,2)")), src=unbilled)
        .unionByName(rows(4 * k + 1, k - 1, k, F.col("CustomerID"), F.lit(None).cast("decimal(10,2)")).where(k % 12 == 0))
        .unionByName(rows(4 * k + 2, none, -k, F.col("CustomerID"), F.lit(None).cast("decimal(10,2)")).where(k % 16 == 0))
        .unionByName(rows(4 * k + 3, none, none, none, F.lit(None).cast("decimal(10,2)")).where(k % 20 == 0))
    )


_INVOICE_SQL = f"""
WITH feed AS (
  SELECT 4 * ReservationID AS change_seq, ReservationID AS invoice_no,
         CASE WHEN ReservationID % 8 <> 0 THEN ReservationID END AS reservation_id, CustomerID AS customer_id,
         CAST(100 + ReservationID % 50 AS DECIMAL(10,2)) AS amount_payable,
         CASE WHEN ReservationID % 3 = 0 THEN CAST(ReservationID % 50 AS DECIMAL(10,2)) END AS amount_paid
  FROM hotel_reservation
  WHERE ReservationID NOT IN (SELECT ReservationID FROM hotel_invoice WHERE ReservationID IS NOT NULL)
  UNION ALL SELECT 4 * ReservationID + 1, ReservationID - 1, ReservationID, CustomerID,
         CAST(100 + ReservationID % 50 AS DECIMAL(10,2)), NULL FROM hotel_reservation WHERE ReservationID % 12 = 0
  UNION ALL SELECT 4 * ReservationID + 2, NULL, -ReservationID, CustomerID,
         CAST(100 + ReservationID % 50 AS DECIMAL(10,2)), NULL FROM hotel_reservation WHERE ReservationID % 16 = 0
  UNION ALL SELECT 4 * ReservationID + 3, NULL, NULL, NULL,
         CAST(100 + ReservationID % 50 AS DECIMAL(10,2)), NULL FROM hotel_reservation WHERE ReservationID % 20 = 0),
ided AS (
  SELECT feed.*, COALESCE(NULLIF(invoice_no, 0), (SELECT max(InvoiceNo) FROM hotel_invoice) + change_seq) AS new_no,
         NULLIF(reservation_id, 0) AS res, COALESCE(NULLIF(amount_paid, 0), 0) AS paid
  FROM feed),
judged AS (
  SELECT ided.*,
         CASE WHEN customer_id IS NULL OR customer_id = 0 THEN '{C.MISSING}'
              WHEN amount_payable IS NULL THEN '{C.MISSING}'
              WHEN abs(amount_payable) >= 100000000 THEN 'size: AmountPayable'
              WHEN abs(paid) >= 100000000 THEN 'size: AmountPaid'
              WHEN new_no IN (SELECT InvoiceNo FROM hotel_invoice) THEN 'duplicate key'
              WHEN res IS NOT NULL AND res NOT IN (SELECT ReservationID FROM hotel_reservation)
                THEN 'foreign_key: ReservationID'
              WHEN customer_id NOT IN (SELECT CustomerID FROM hotel_customer) THEN 'foreign_key: CustomerID'
         END AS reason0
  FROM ided),
final AS (
  SELECT judged.*,
         CASE WHEN reason0 IS NULL
                   AND change_seq <> min(CASE WHEN reason0 IS NULL THEN change_seq END) OVER (PARTITION BY new_no)
              THEN 'duplicate key' ELSE reason0 END AS reason
  FROM judged)
"""

register("invoice_creations", _INVOICE_SQL + f"""
SELECT {_INV_COLS} FROM hotel_invoice
UNION ALL
SELECT new_no, res, customer_id, amount_payable, CAST(paid AS DECIMAL(10,2)) FROM final WHERE reason IS NULL
""")(lambda c: C.create_invoices(c.T, invoice_feed(c.T))[0]["invoice"])

register("invoice_creation_rejects", _INVOICE_SQL + """
SELECT change_seq, invoice_no, reservation_id, customer_id, amount_payable, amount_paid, reason
FROM final WHERE reason IS NOT NULL
""")(lambda c: C.create_invoices(c.T, invoice_feed(c.T))[1])


# ========================================================== I14 staff onboarding

def staff_feed(T) -> DataFrame:
    s = T["staff"]
    k = F.col("StaffID")
    return s.select(
        k.alias(SEQ),
        F.lit(None).cast("bigint").alias("staff_id"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("StaffFName")).alias("fname"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("StaffLName")).alias("lname"),
        F.when(k % 7 == 0, F.concat(F.lit("New  Staff "), k.cast("string"))).alias("full_name"),
        F.when(k % 9 == 0, F.lit("Chef")).when(k % 4 == 1, F.lit("Housekeeping")).otherwise(F.lit("Front Desk")).alias("role"),
        F.when(k % 11 == 0, F.lit("Night")).otherwise(F.lit("Morning")).alias("shift"),
        (k % 25).cast("int").alias("floor"),
    )


_STAFF_SQL = f"""
WITH feed AS (
  SELECT StaffID AS change_seq, CAST(NULL AS BIGINT) AS staff_id,
         CASE WHEN StaffID % 7 = 0 THEN NULL ELSE StaffFName END AS fname,
         CASE WHEN StaffID % 7 = 0 THEN NULL ELSE StaffLName END AS lname,
         CASE WHEN StaffID % 7 = 0 THEN 'New  Staff ' || CAST(StaffID AS VARCHAR) END AS full_name,
         CASE WHEN StaffID % 9 = 0 THEN 'Chef' WHEN StaffID % 4 = 1 THEN 'Housekeeping' ELSE 'Front Desk' END AS role,
         CASE WHEN StaffID % 11 = 0 THEN 'Night' ELSE 'Morning' END AS shift,
         CAST(StaffID % 25 AS INTEGER) AS floor
  FROM hotel_staff),
named AS (
  SELECT feed.*,
         CASE WHEN fname IS NULL AND full_name IS NOT NULL THEN regexp_extract(full_name, '^\\s*(\\S+)', 1)
              ELSE fname END AS f,
         CASE WHEN fname IS NULL AND full_name IS NOT NULL THEN regexp_extract(full_name, '^\\s*\\S+\\s+(.*)$', 1)
              ELSE lname END AS l,
         fname IS NULL AND full_name IS NOT NULL AS via_full,
         (SELECT max(StaffID) FROM hotel_staff) + change_seq AS new_id,
         CASE WHEN role = 'Housekeeping' THEN COALESCE(NULLIF(floor, 0), 0) END AS fl
  FROM feed),
judged AS (
  SELECT named.*,
         CASE WHEN f IS NULL OR f = '' OR role IS NULL OR role = '' OR shift IS NULL OR shift = '' THEN '{C.MISSING}'
              WHEN NOT via_full AND (l IS NULL OR l = '') THEN '{C.MISSING}'
              WHEN shift NOT IN ('Morning', 'Afternoon', 'Evening') THEN 'enum: Shift'
              WHEN fl IS NOT NULL AND fl NOT BETWEEN 0 AND 20 THEN 'range: AssignedFloor'
              WHEN role NOT IN ('Housekeeping', 'Front Desk') THEN 'enum: StaffRole'
              WHEN length(f) > 20 THEN 'size: StaffFName'
              WHEN length(l) > 20 THEN 'size: StaffLName'
              WHEN new_id IN (SELECT StaffID FROM hotel_staff) THEN 'duplicate key' END AS reason
  FROM named)
"""

register("staff_onboarding", _STAFF_SQL + """
SELECT StaffID, StaffFName, StaffLName, StaffRole FROM hotel_staff
UNION ALL
SELECT new_id, f, l, role FROM judged WHERE reason IS NULL
""")(lambda c: C.onboard_staff(c.T, staff_feed(c.T))[0]["staff"])

register("staff_onboarding_housekeeping", _STAFF_SQL + """
SELECT StaffID, Shift, AssignedFloor FROM hotel_housekeeping
UNION ALL
SELECT new_id, shift, fl FROM judged WHERE reason IS NULL AND role = 'Housekeeping'
""")(lambda c: C.onboard_staff(c.T, staff_feed(c.T))[0]["housekeeping"])

register("staff_onboarding_frontdesk", _STAFF_SQL + """
SELECT StaffID, Shift FROM hotel_frontdesk
UNION ALL
SELECT new_id, shift FROM judged WHERE reason IS NULL AND role <> 'Housekeeping'
""")(lambda c: C.onboard_staff(c.T, staff_feed(c.T))[0]["frontdesk"])

register("staff_onboarding_rejects", _STAFF_SQL + """
SELECT change_seq, staff_id, fname, lname, full_name, role, shift, floor, reason FROM judged WHERE reason IS NOT NULL
""")(lambda c: C.onboard_staff(c.T, staff_feed(c.T))[1])


# ================================================ I1, I17, I18 rooms (upsert, add, edit)

def room_upsert_feed(T) -> DataFrame:
    rm = T["room"]
    k = F.col("RoomNo")
    cols = [c for c in rm.columns if c != "RoomRate"]
    a = rm.select(*cols, (F.col("RoomRate") + 10).cast("decimal(10,2)").alias("RoomRate"),
                                    F.lit(1).cast("bigint").alias(SEQ))
    b = rm.where(k % 12 == 0).select(*cols, (F.col("RoomRate") + 20).cast("decimal(10,2)").alias("RoomRate"),
                                     F.lit(2).cast("bigint").alias(SEQ))
    new = rm.where(k % 30 == 0).select((-k).alias("RoomNo"), *[c for c in cols if c != "RoomNo"], "RoomRate",
                                       F.lit(1).cast("bigint").alias(SEQ))
    return a.unionByName(b).unionByName(new)


register("room_upserts", f"""
WITH feed AS (
  SELECT RoomNo, RoomType, CAST(RoomRate + 10 AS DECIMAL(10,2)) AS RoomRate, RoomStatus, HousekeeperID, 1 AS seq
  FROM hotel_room
  UNION ALL SELECT RoomNo, RoomType, CAST(RoomRate + 20 AS DECIMAL(10,2)), RoomStatus, HousekeeperID, 2
  FROM hotel_room WHERE RoomNo % 12 = 0
  UNION ALL SELECT -RoomNo, RoomType, RoomRate, RoomStatus, HousekeeperID, 1 FROM hotel_room WHERE RoomNo % 30 = 0),
last AS (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY RoomNo ORDER BY seq DESC) = 1)
SELECT {_ROOM_COLS} FROM hotel_room WHERE RoomNo NOT IN (SELECT RoomNo FROM last)
UNION ALL
SELECT {_ROOM_COLS} FROM last
""")(lambda c: C.upsert(c.T["room"], room_upsert_feed(c.T), "RoomNo"))


# ------------------------------------------------ I1 on stored tables, cut by key or day

def _stored_merge(c: Context, table: str, layout: keyed.Layout, changes: DataFrame) -> DataFrame:
    path, rows = new_folder(c.spark, table), c.T[table]
    keyed.store(rows, path, layout)
    keyed.merge(c.spark, path, layout, changes, rows.schema)
    return keyed.load(c.spark, path, layout, rows.schema)


def room_rate_feed(T) -> DataFrame:
    """New rates for the rooms of every third hundred, some set twice, and rooms after the last one."""
    rm, k = T["room"], F.col("RoomNo")
    cols = [c for c in rm.columns if c != "RoomRate"]
    some = rm.where(F.floor(k / 100) % 3 == 1)
    a = some.select(*cols, (F.col("RoomRate") + k % 7).cast("decimal(10,2)").alias("RoomRate"), (2 * k).alias(SEQ))
    b = some.where(k % 12 == 0).select(*cols, F.lit("99.50").cast("decimal(10,2)").alias("RoomRate"), (2 * k + 1).alias(SEQ))
    top = rm.agg(F.max("RoomNo")).scalar()
    new = rm.where(k % 40 == 0).select((top + k + 1).alias("RoomNo"), *[c for c in cols if c != "RoomNo"], "RoomRate", (2 * k).alias(SEQ))
    return a.unionByName(b).unionByName(new)


register("room_range_merges", f"""
WITH feed AS (
  SELECT RoomNo, RoomType, CAST(RoomRate + RoomNo % 7 AS DECIMAL(10,2)) AS RoomRate, RoomStatus, HousekeeperID, 2 * RoomNo AS seq
  FROM hotel_room WHERE (RoomNo // 100) % 3 = 1
  UNION ALL SELECT RoomNo, RoomType, 99.50, RoomStatus, HousekeeperID, 2 * RoomNo + 1
  FROM hotel_room WHERE (RoomNo // 100) % 3 = 1 AND RoomNo % 12 = 0
  UNION ALL SELECT (SELECT max(RoomNo) FROM hotel_room) + RoomNo + 1, RoomType, RoomRate, RoomStatus, HousekeeperID, 2 * RoomNo
  FROM hotel_room WHERE RoomNo % 40 = 0),
last AS (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY RoomNo ORDER BY seq DESC) = 1)
SELECT {_ROOM_COLS} FROM hotel_room WHERE RoomNo NOT IN (SELECT RoomNo FROM last)
UNION ALL
SELECT {_ROOM_COLS} FROM last
""")(lambda c: _stored_merge(c, "room", keyed.Layout("RoomNo", width=100), room_rate_feed(c.T)))


def event_move_feed(T) -> DataFrame:
    """Events of the first days of a month move on by up to two days; some twice, the last change wins."""
    ev, k = T["event"], F.col("EventID")
    early = ev.where(F.dayofmonth("EventDate") <= 4)
    rest = [c for c in ev.columns if c != "EventDate"]
    a = early.select(*rest, F.date_add("EventDate", (k % 3).cast("int")).alias("EventDate"), (2 * k).alias(SEQ))
    b = early.where(k % 5 == 0).select(*rest, F.date_sub("EventDate", 40).alias("EventDate"), (2 * k + 1).alias(SEQ))
    return a.unionByName(b)


register("event_moves", """
SELECT EventID, EventType,
       CAST(CASE WHEN dayofmonth(EventDate) > 4 THEN EventDate
                 WHEN EventID % 5 = 0 THEN EventDate - 40 ELSE EventDate + CAST(EventID % 3 AS INTEGER) END AS DATE) AS EventDate,
       EventDuration, Host, HallID
FROM hotel_event
""")(lambda c: _stored_merge(c, "event", keyed.Layout("EventID", column="EventDate"), event_move_feed(c.T)))


def room_add_feed(T) -> DataFrame:
    rm = T["room"]
    k = F.col("RoomNo")
    a = rm.select(
        (2 * k).alias(SEQ), F.lit(None).cast("bigint").alias("room_no"), F.col("RoomType").alias("room_type"),
        F.when(k % 50 == 0, F.lit(0)).otherwise(F.col("RoomRate") + 1).cast("decimal(10,2)").alias("rate"),
        F.col("HousekeeperID").alias("housekeeper_id"),
    )
    b = rm.where(k % 75 == 0).select(
        (2 * k + 1).alias(SEQ), k.alias("room_no"), F.col("RoomType").alias("room_type"),
        F.col("RoomRate").alias("rate"), F.lit(None).cast("bigint").alias("housekeeper_id"),
    )
    return a.unionByName(b)


_ROOM_ADD_SQL = f"""
WITH feed AS (
  SELECT 2 * RoomNo AS change_seq, CAST(NULL AS BIGINT) AS room_no, RoomType AS room_type,
         CAST(CASE WHEN RoomNo % 50 = 0 THEN 0 ELSE RoomRate + 1 END AS DECIMAL(10,2)) AS rate,
         HousekeeperID AS housekeeper_id
  FROM hotel_room
  UNION ALL SELECT 2 * RoomNo + 1, RoomNo, RoomType, RoomRate, NULL FROM hotel_room WHERE RoomNo % 75 = 0),
ided AS (
  SELECT feed.*, COALESCE(NULLIF(room_no, 0), (SELECT max(RoomNo) FROM hotel_room) + change_seq) AS new_no,
         NULLIF(housekeeper_id, 0) AS hk
  FROM feed),
judged AS (
  SELECT ided.*,
         CASE WHEN room_type IS NULL OR room_type = '' OR rate IS NULL OR rate = 0 THEN '{C.MISSING}'
              WHEN length(room_type) > 30 THEN 'size: RoomType'
              WHEN abs(rate) >= 100000000 THEN 'size: RoomRate'
              WHEN new_no IN (SELECT RoomNo FROM hotel_room) THEN 'duplicate key'
              WHEN hk IS NOT NULL AND hk NOT IN (SELECT StaffID FROM hotel_housekeeping) THEN 'foreign_key: HousekeeperID'
         END AS reason
  FROM ided)
"""

register("room_additions", _ROOM_ADD_SQL + f"""
SELECT {_ROOM_COLS} FROM hotel_room
UNION ALL
SELECT new_no, room_type, rate, 'Vacant', hk FROM judged WHERE reason IS NULL
""")(lambda c: C.add_rooms(c.T, room_add_feed(c.T))[0]["room"])

register("room_addition_rejects", _ROOM_ADD_SQL + """
SELECT change_seq, room_no, room_type, rate, housekeeper_id, reason FROM judged WHERE reason IS NOT NULL
""")(lambda c: C.add_rooms(c.T, room_add_feed(c.T))[1])


def room_edit_feed(T) -> DataFrame:
    rm = T["room"]
    k = F.col("RoomNo")
    a = rm.select(
        (2 * k).alias(SEQ), k.alias("room_no"), F.concat(F.col("RoomType"), F.lit(" X")).alias("room_type"),
        (F.col("RoomRate") * 2).cast("decimal(10,2)").alias("rate"),
    )
    b = rm.where(k % 50 == 1).select(
        (2 * k + 1).alias(SEQ), k.alias("room_no"), F.col("RoomType").alias("room_type"),
        F.lit(None).cast("decimal(10,2)").alias("rate"),
    )
    return a.unionByName(b)


_ROOM_EDIT_SQL = """
WITH feed AS (
  SELECT 2 * RoomNo AS change_seq, RoomNo AS room_no, RoomType || ' X' AS room_type,
         CAST(RoomRate * 2 AS DECIMAL(10,2)) AS rate
  FROM hotel_room
  UNION ALL SELECT 2 * RoomNo + 1, RoomNo, RoomType, NULL FROM hotel_room WHERE RoomNo % 50 = 1),
judged AS (
  SELECT f.*, CASE WHEN r.RoomNo IS NULL THEN 'not found'
                   WHEN f.room_type IS NULL THEN 'not_null: RoomType'
                   WHEN f.rate IS NULL THEN 'not_null: RoomRate'
                   WHEN length(f.room_type) > 30 THEN 'size: RoomType'
                   WHEN abs(f.rate) >= 100000000 THEN 'size: RoomRate' END AS reason
  FROM feed f LEFT JOIN hotel_room r ON r.RoomNo = f.room_no),
last AS (
  SELECT * FROM judged WHERE reason IS NULL
  QUALIFY row_number() OVER (PARTITION BY room_no ORDER BY change_seq DESC) = 1)
"""

register("room_updates", _ROOM_EDIT_SQL + """
SELECT r.RoomNo, COALESCE(l.room_type, r.RoomType) AS RoomType, COALESCE(l.rate, r.RoomRate) AS RoomRate,
       r.RoomStatus, r.HousekeeperID
FROM hotel_room r LEFT JOIN last l ON l.room_no = r.RoomNo
""")(lambda c: C.update_rooms(c.T, room_edit_feed(c.T))[0]["room"])

register("room_update_rejects", _ROOM_EDIT_SQL + """
SELECT change_seq, room_no, room_type, rate, reason FROM judged WHERE reason IS NOT NULL
""")(lambda c: C.update_rooms(c.T, room_edit_feed(c.T))[1])

register("room_delete_rejects", f"""
SELECT 2 * RoomNo AS change_seq, RoomNo AS room_no, '{C.ROOM_DELETE}' AS reason FROM hotel_room
""")(lambda c: C.block_room_deletes(
    c.T["room"].select((2 * F.col("RoomNo")).alias(SEQ), F.col("RoomNo").alias("room_no"))
))


# ============================================= I19 inserts (events, orders, feedback)

def event_feed(T) -> DataFrame:
    ev = T["event"]
    k = F.col("EventID")
    return ev.select(
        k.alias(SEQ),
        F.lit(None).cast("bigint").alias("event_id"),
        F.when(k % 60 == 0, F.lit("Gala")).otherwise(F.col("EventType")).alias("event_type"),
        F.date_format(F.date_add("EventDate", 365), "yyyy-MM-dd").alias("event_date"),
        F.col("EventDuration").alias("duration"),
        F.col("Host").alias("host_id"),
        F.when(k % 40 == 0, F.lit(99).cast("bigint")).otherwise(F.col("HallID")).alias("hall_id"),
    )


_EVENT_SQL = f"""
WITH feed AS (
  SELECT EventID AS change_seq, CAST(NULL AS BIGINT) AS event_id,
         CASE WHEN EventID % 60 = 0 THEN 'Gala' ELSE EventType END AS event_type,
         strftime(EventDate + INTERVAL 365 DAY, '%Y-%m-%d') AS event_date, EventDuration AS duration,
         Host AS host_id, CASE WHEN EventID % 40 = 0 THEN CAST(99 AS BIGINT) ELSE HallID END AS hall_id
  FROM hotel_event),
judged AS (
  SELECT feed.*, (SELECT max(EventID) FROM hotel_event) + change_seq AS new_id,
         CASE WHEN event_type IS NULL OR event_type = '' OR event_date IS NULL OR event_date = ''
                   OR duration IS NULL OR duration = 0 OR host_id IS NULL OR host_id = 0
                   OR hall_id IS NULL OR hall_id = 0 THEN '{C.MISSING}'
              WHEN event_type NOT IN ('Wedding', 'Conference', 'Seminar', 'Networking Event', 'Birthday Party')
                THEN 'enum: EventType'
              WHEN abs(duration) >= 1000 THEN 'size: EventDuration'
              WHEN (SELECT max(EventID) FROM hotel_event) + change_seq IN (SELECT EventID FROM hotel_event)
                THEN 'duplicate key'
              WHEN hall_id NOT IN (SELECT HallID FROM hotel_conference_hall) THEN 'foreign_key: HallID'
              WHEN host_id NOT IN (SELECT CustomerID FROM hotel_customer) THEN 'foreign_key: Host' END AS reason
  FROM feed)
"""

register("event_additions", _EVENT_SQL + """
SELECT EventID, EventType, EventDate, EventDuration, Host, HallID FROM hotel_event
UNION ALL
SELECT new_id, event_type, CAST(event_date AS DATE), duration, host_id, hall_id FROM judged WHERE reason IS NULL
""")(lambda c: C.add_events(c.T, event_feed(c.T))[0]["event"])

register("event_addition_rejects", _EVENT_SQL + """
SELECT change_seq, event_id, event_type, event_date, duration, host_id, hall_id, reason FROM judged
WHERE reason IS NOT NULL
""")(lambda c: C.add_events(c.T, event_feed(c.T))[1])


def order_feed(T) -> DataFrame:
    r = T["reservation"]
    k = F.col("ReservationID")
    return r.select(
        k.alias(SEQ),
        F.lit(None).cast("bigint").alias("order_id"),
        F.col("CustomerID").alias("customer_id"),
        (k % 7).alias("restaurant_id"),
        F.when(k % 4 != 0, k).alias("invoice_id"),
        F.concat(F.lit("1x item "), k.cast("string")).alias("order_details"),
    )


_ORDER_SQL = f"""
WITH feed AS (
  SELECT ReservationID AS change_seq, CAST(NULL AS BIGINT) AS order_id, CustomerID AS customer_id,
         ReservationID % 7 AS restaurant_id, CASE WHEN ReservationID % 4 <> 0 THEN ReservationID END AS invoice_id,
         '1x item ' || CAST(ReservationID AS VARCHAR) AS order_details
  FROM hotel_reservation),
judged AS (
  SELECT feed.*, (SELECT max(OrderID) FROM hotel_restaurant_order) + change_seq AS new_id,
         NULLIF(invoice_id, 0) AS inv,
         CASE WHEN customer_id IS NULL OR customer_id = 0 OR restaurant_id IS NULL OR restaurant_id = 0
                   OR order_details IS NULL OR order_details = '' THEN '{C.MISSING}'
              WHEN (SELECT max(OrderID) FROM hotel_restaurant_order) + change_seq
                   IN (SELECT OrderID FROM hotel_restaurant_order) THEN 'duplicate key'
              WHEN customer_id NOT IN (SELECT CustomerID FROM hotel_customer) THEN 'foreign_key: CustomerID'
              WHEN restaurant_id NOT IN (SELECT RestaurantID FROM hotel_restaurant) THEN 'foreign_key: RestaurantID'
              WHEN NULLIF(invoice_id, 0) IS NOT NULL AND invoice_id NOT IN (SELECT InvoiceNo FROM hotel_invoice)
                THEN 'foreign_key: InvoiceID' END AS reason
  FROM feed)
"""

register("order_additions", _ORDER_SQL + """
SELECT OrderID, CustomerID, RestaurantID, InvoiceID, OrderDetails FROM hotel_restaurant_order
UNION ALL
SELECT new_id, customer_id, restaurant_id, inv, order_details FROM judged WHERE reason IS NULL
""")(lambda c: C.add_orders(c.T, order_feed(c.T))[0]["restaurant_order"])

register("order_addition_rejects", _ORDER_SQL + """
SELECT change_seq, order_id, customer_id, restaurant_id, invoice_id, order_details, reason FROM judged
WHERE reason IS NOT NULL
""")(lambda c: C.add_orders(c.T, order_feed(c.T))[1])


def numbered_feed(T) -> DataFrame:
    """Customers with missing, negative and repeated change numbers; the rest are valid."""
    k = F.col("CustomerID")
    seq = F.when(k % 5 == 1, -k).when(k % 5 == 3, k - 1).when(k % 5 != 0, k)
    return T["customer"].select(seq.alias(SEQ), F.col("CustomerFName").alias("fname"), F.col("CustomerLName").alias("lname"), F.col("PhoneNumber").alias("phone"))


register("customer_numbered_rejects", f"""
WITH feed AS (
  SELECT CASE CustomerID % 5 WHEN 0 THEN NULL WHEN 1 THEN -CustomerID WHEN 3 THEN CustomerID - 1 ELSE CustomerID END AS change_seq,
         CustomerFName AS fname, CustomerLName AS lname, PhoneNumber AS phone
  FROM hotel_customer),
counted AS (SELECT *, count(change_seq) OVER (PARTITION BY change_seq) AS n FROM feed)
SELECT change_seq, fname, lname, phone, '{C.BAD_SEQ}' AS reason FROM counted
WHERE change_seq IS NULL OR change_seq < 0 OR n > 1
""")(lambda c: C.add_customers(c.T, numbered_feed(c.T))[1])


def paid_feed(T) -> DataFrame:
    """The endpoint's form: AmountPaid is set; some amounts missing, some invoices unknown, some set twice."""
    k = F.col("InvoiceNo")
    first = T["invoice"].select(
        (2 * k).alias(SEQ), F.when(k % 13 == 0, -k).otherwise(k).alias("invoice_no"),
        F.when(k % 7 != 0, (k % 500).cast("decimal(10,2)")).alias("amount_paid"),
    )
    again = T["invoice"].where(k % 6 == 1).select((2 * k + 1).alias(SEQ), k.alias("invoice_no"), F.lit("0.50").cast("decimal(10,2)").alias("amount_paid"))
    return first.unionByName(again)


_PAID_SQL = """
WITH feed AS (
  SELECT 2 * InvoiceNo AS change_seq, CASE WHEN InvoiceNo % 13 = 0 THEN -InvoiceNo ELSE InvoiceNo END AS invoice_no,
         CASE WHEN InvoiceNo % 7 <> 0 THEN CAST(InvoiceNo % 500 AS DECIMAL(10,2)) END AS amount_paid
  FROM hotel_invoice
  UNION ALL
  SELECT 2 * InvoiceNo + 1, InvoiceNo, CAST(0.5 AS DECIMAL(10,2)) FROM hotel_invoice WHERE InvoiceNo % 6 = 1),
judged AS (
  SELECT *, CASE WHEN invoice_no NOT IN (SELECT InvoiceNo FROM hotel_invoice) THEN 'not found'
                 WHEN amount_paid IS NULL THEN 'not_null: AmountPaid' END AS reason
  FROM feed),
last AS (SELECT invoice_no AS InvoiceNo, arg_max(amount_paid, change_seq) AS paid FROM judged WHERE reason IS NULL GROUP BY 1)
"""

register("paid_invoices", _PAID_SQL + """
SELECT * EXCLUDE (AmountPaid, paid), coalesce(paid, AmountPaid) AS AmountPaid FROM hotel_invoice LEFT JOIN last USING (InvoiceNo)
""")(lambda c: C.set_amount_paid(c.T, paid_feed(c.T))[0]["invoice"])

register("paid_rejects", _PAID_SQL + """
SELECT * FROM judged WHERE reason IS NOT NULL
""")(lambda c: C.set_amount_paid(c.T, paid_feed(c.T))[1])


def feedback_feed(T) -> DataFrame:
    fb = T["customer_feedback"]
    k = F.col("FeedbackID")
    return fb.select(
        k.alias(SEQ),
        F.lit(None).cast("bigint").alias("feedback_id"),
        F.col("CustomerID").alias("customer_id"),
        F.when(k % 10 == 7, "99999999999").otherwise(F.col("Rating").cast("string")).alias("rating"),  # some don't fit an int
        F.col("Comments").alias("comments"),
    )


_FEEDBACK_SQL = f"""
WITH feed AS (
  SELECT FeedbackID AS change_seq, CAST(NULL AS BIGINT) AS feedback_id, CustomerID AS customer_id,
         CASE WHEN FeedbackID % 10 = 7 THEN '99999999999' ELSE CAST(Rating AS VARCHAR) END AS rating, Comments AS comments
  FROM hotel_customer_feedback),
judged AS (
  SELECT feed.*, (SELECT max(FeedbackID) FROM hotel_customer_feedback) + change_seq AS new_id,
         TRY_CAST(CASE WHEN regexp_full_match(trim(rating), '[+-]?[0-9]+') THEN trim(rating) END AS INTEGER) AS r,
         CASE WHEN customer_id IS NULL OR customer_id = 0 OR rating IS NULL OR rating = ''
                   OR comments IS NULL OR comments = '' THEN '{C.MISSING}'
              WHEN TRY_CAST(CASE WHEN regexp_full_match(trim(rating), '[+-]?[0-9]+') THEN trim(rating) END AS HUGEINT)
                   NOT BETWEEN 1 AND 5
                OR NOT regexp_full_match(trim(rating), '[+-]?[0-9]+') THEN '{C.BAD_RATING}'
              WHEN (SELECT max(FeedbackID) FROM hotel_customer_feedback) + change_seq
                   IN (SELECT FeedbackID FROM hotel_customer_feedback) THEN 'duplicate key'
              WHEN customer_id NOT IN (SELECT CustomerID FROM hotel_customer) THEN 'foreign_key: CustomerID' END AS reason
  FROM feed)
"""

register("feedback_additions", _FEEDBACK_SQL + f"""
SELECT FeedbackID, CustomerID, Rating, Comments, FeedbackDate FROM hotel_customer_feedback
UNION ALL
SELECT new_id, customer_id, r, comments, DATE '{AS_OF}' FROM judged WHERE reason IS NULL
""")(lambda c: C.add_feedback(c.T, feedback_feed(c.T), AS_OF)[0]["customer_feedback"])

register("feedback_addition_rejects", _FEEDBACK_SQL + """
SELECT change_seq, feedback_id, customer_id, rating, comments, reason FROM judged WHERE reason IS NOT NULL
""")(lambda c: C.add_feedback(c.T, feedback_feed(c.T), AS_OF)[1])


# ============================================================ I20 feedback removal

def feedback_removal_feed(T) -> DataFrame:
    fb = T["customer_feedback"]
    k = F.col("FeedbackID")
    # every third removal names no feedback
    return fb.select((2 * k).alias(SEQ), F.when(k % 3 == 0, -k - 1).otherwise(k).alias("feedback_id")).unionByName(
        fb.where(k % 14 == 0).select((2 * k + 1).alias(SEQ), (-k).alias("feedback_id"))
    )


_FEEDBACK_REMOVAL_SQL = """
WITH feed AS (
  SELECT 2 * FeedbackID AS change_seq, CASE WHEN FeedbackID % 3 = 0 THEN -FeedbackID - 1 ELSE FeedbackID END AS feedback_id
  FROM hotel_customer_feedback
  UNION ALL SELECT 2 * FeedbackID + 1, -FeedbackID FROM hotel_customer_feedback WHERE FeedbackID % 14 = 0),
judged AS (
  SELECT feed.*, CASE WHEN feedback_id NOT IN (SELECT FeedbackID FROM hotel_customer_feedback) THEN 'not found'
                      WHEN change_seq <> min(change_seq) OVER (PARTITION BY feedback_id) THEN 'not found' END
    AS reason
  FROM feed)
"""

register("feedback_removals", _FEEDBACK_REMOVAL_SQL + """
SELECT FeedbackID, CustomerID, Rating, Comments, FeedbackDate FROM hotel_customer_feedback
WHERE FeedbackID NOT IN (SELECT feedback_id FROM judged WHERE reason IS NULL)
""")(lambda c: C.remove_feedback(c.T, feedback_removal_feed(c.T))[0]["customer_feedback"])

register("feedback_removal_rejects", _FEEDBACK_REMOVAL_SQL + """
SELECT change_seq, feedback_id, reason FROM judged WHERE reason IS NOT NULL
""")(lambda c: C.remove_feedback(c.T, feedback_removal_feed(c.T))[1])


# ================================================== I19 halls and restaurants

def hall_feed(T) -> DataFrame:
    # one requested hall per event: grows with the event table
    e = T["event"]
    k = F.col("EventID")
    return e.select(
        (k + 1).alias(SEQ),
        F.lit(None).cast("bigint").alias("hall_id"),
        F.concat(F.lit("Hall for "), F.col("EventType")).alias("name"),
        (k % 300).cast("int").alias("capacity"),
    )


_HALL_SQL = f"""
WITH feed AS (
  SELECT EventID + 1 AS change_seq, CAST(NULL AS BIGINT) AS hall_id, 'Hall for ' || EventType AS name,
         CAST(EventID % 300 AS INTEGER) AS capacity
  FROM hotel_event),
judged AS (
  SELECT feed.*, (SELECT max(HallID) FROM hotel_conference_hall) + change_seq AS new_id,
         CASE WHEN name IS NULL OR name = '' OR capacity IS NULL OR capacity = 0 THEN '{C.MISSING}'
              WHEN length(name) > 50 THEN 'size: HallName'
              WHEN (SELECT max(HallID) FROM hotel_conference_hall) + change_seq
                   IN (SELECT HallID FROM hotel_conference_hall) THEN 'duplicate key' END AS reason
  FROM feed)
"""

register("hall_additions", _HALL_SQL + """
SELECT HallID, HallName, Capacity FROM hotel_conference_hall
UNION ALL SELECT new_id, name, capacity FROM judged WHERE reason IS NULL
""")(lambda c: C.add_halls(c.T, hall_feed(c.T))[0]["conference_hall"])

register("hall_addition_rejects", _HALL_SQL + """
SELECT change_seq, hall_id, name, capacity, reason FROM judged WHERE reason IS NOT NULL
""")(lambda c: C.add_halls(c.T, hall_feed(c.T))[1])


def restaurant_feed(T) -> DataFrame:
    # one requested restaurant per order: grows with the orders table
    r = T["reservation"]
    k = F.col("ReservationID")
    return r.select(
        k.alias(SEQ),
        F.when(k % 700 == 0, F.lit(1)).cast("bigint").alias("restaurant_id"),
        F.concat(F.lit("Bistro "), k.cast("string")).alias("name"),
        (k % 120).cast("int").alias("seating_capacity"),
    )


_RESTAURANT_SQL = f"""
WITH feed AS (
  SELECT ReservationID AS change_seq, CAST(CASE WHEN ReservationID % 700 = 0 THEN 1 END AS BIGINT) AS restaurant_id,
         'Bistro ' || CAST(ReservationID AS VARCHAR) AS name, CAST(ReservationID % 120 AS INTEGER) AS seating_capacity
  FROM hotel_reservation),
judged AS (
  SELECT feed.*, COALESCE(NULLIF(restaurant_id, 0), (SELECT max(RestaurantID) FROM hotel_restaurant) + change_seq)
           AS new_id,
         CASE WHEN name IS NULL OR name = '' OR seating_capacity IS NULL OR seating_capacity = 0 THEN '{C.MISSING}'
              WHEN length(name) > 50 THEN 'size: RestaurantName'
              WHEN COALESCE(NULLIF(restaurant_id, 0), (SELECT max(RestaurantID) FROM hotel_restaurant) + change_seq)
                   IN (SELECT RestaurantID FROM hotel_restaurant) THEN 'duplicate key' END AS reason
  FROM feed)
"""

register("restaurant_additions", _RESTAURANT_SQL + """
SELECT RestaurantID, RestaurantName, SeatingCapacity FROM hotel_restaurant
UNION ALL SELECT new_id, name, seating_capacity FROM judged WHERE reason IS NULL
""")(lambda c: C.add_restaurants(c.T, restaurant_feed(c.T))[0]["restaurant"])

register("restaurant_addition_rejects", _RESTAURANT_SQL + """
SELECT change_seq, restaurant_id, name, seating_capacity, reason FROM judged WHERE reason IS NOT NULL
""")(lambda c: C.add_restaurants(c.T, restaurant_feed(c.T))[1])
