"""Registry entries of the sources and sinks (A2-A4) in their column forms, with their oracles.

The text that is loaded is made from a whole bookings table, one record a row;
which records are damaged is a rule on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..operators import changes as C, views
from ..sources import tables
from .catalog import Context, register

# ============================================================== A2 bulk load of CSV text


def _csv(*columns) -> F.Column:
    return F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def invoice_lines(T_) -> DataFrame:
    """Invoices as CSV: unreadable amounts, amounts too wide, fields missing or too many, no customer, unknown customers, repeated keys."""
    k, payable = F.col("InvoiceNo"), F.col("AmountPayable").cast("string")
    payable = F.when(k % 31 == 0, "n/a").when(k % 47 == 0, "99999999999.00").otherwise(payable)
    customer = F.when(k % 43 == 0, "").when(k % 59 == 0, (-k).cast("string")).otherwise(F.col("CustomerID").cast("string"))
    line = F.when(k % 37 == 0, _csv(k, F.col("ReservationID"), customer, payable)).otherwise(_csv(k, F.col("ReservationID"), customer, payable, F.col("AmountPaid")))
    line = F.when(k % 41 == 0, F.concat(line, F.lit(",x"))).otherwise(line)
    again = F.when(k % 53 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return T_["invoice"].select(line.alias("line"), F.explode(again).alias("copy")).select("line")


_INVOICE_LOAD_SQL = """
WITH lines AS (
  SELECT InvoiceNo || ',' || COALESCE(CAST(ReservationID AS VARCHAR), '') || ','
         || CASE WHEN InvoiceNo % 43 = 0 THEN '' WHEN InvoiceNo % 59 = 0 THEN CAST(-InvoiceNo AS VARCHAR) ELSE CAST(CustomerID AS VARCHAR) END || ','
         || CASE WHEN InvoiceNo % 31 = 0 THEN 'n/a' WHEN InvoiceNo % 47 = 0 THEN '99999999999.00' ELSE CAST(AmountPayable AS VARCHAR) END
         || CASE WHEN InvoiceNo % 37 = 0 THEN '' ELSE ',' || CAST(AmountPaid AS VARCHAR) END
         || CASE WHEN InvoiceNo % 41 = 0 THEN ',x' ELSE '' END AS line,
         unnest(CASE WHEN InvoiceNo % 53 = 0 THEN [0, 1] ELSE [0] END) AS copy
  FROM hotel_invoice),
parts AS (SELECT line, list_transform(string_split(line, ','), lambda x: NULLIF(x, '')) AS f FROM lines),
typed AS (
  SELECT line, TRY_CAST(f[1] AS BIGINT) AS InvoiceNo, TRY_CAST(f[2] AS BIGINT) AS ReservationID, TRY_CAST(f[3] AS BIGINT) AS CustomerID,
         TRY_CAST(f[4] AS DECIMAL(10,2)) AS AmountPayable, TRY_CAST(f[5] AS DECIMAL(10,2)) AS AmountPaid, len(f) AS n, f
  FROM parts),
good AS (
  SELECT InvoiceNo, ReservationID, CustomerID, AmountPayable, AmountPaid, line FROM typed
  WHERE n = 5 AND (f[1] IS NULL) = (InvoiceNo IS NULL) AND (f[2] IS NULL) = (ReservationID IS NULL) AND (f[3] IS NULL) = (CustomerID IS NULL)
    AND (f[4] IS NULL) = (AmountPayable IS NULL) AND (f[5] IS NULL) = (AmountPaid IS NULL)),
violations AS (
  SELECT 'unreadable' AS rule, NULL AS column_name, NULL AS row_key, line AS bad_value FROM lines WHERE line NOT IN (SELECT line FROM good)
  UNION ALL SELECT 'unique', 'InvoiceNo', CAST(InvoiceNo AS VARCHAR), CAST(count(*) AS VARCHAR) FROM good GROUP BY InvoiceNo HAVING count(*) > 1
  UNION ALL SELECT 'not_null', 'CustomerID', CAST(InvoiceNo AS VARCHAR), NULL FROM good WHERE CustomerID IS NULL
  UNION ALL SELECT 'foreign_key', 'CustomerID', CAST(InvoiceNo AS VARCHAR), CAST(CustomerID AS VARCHAR) FROM good
  WHERE CustomerID NOT IN (SELECT CustomerID FROM hotel_customer)
  UNION ALL SELECT 'foreign_key', 'ReservationID', CAST(InvoiceNo AS VARCHAR), CAST(ReservationID AS VARCHAR) FROM good
  WHERE ReservationID NOT IN (SELECT ReservationID FROM hotel_reservation))
"""


def _invoice_load(c: Context):
    return tables.load_lines(invoice_lines(c.T), "invoice", id_type=T.LongType(), parents=c.T)


register("loaded_invoices", _INVOICE_LOAD_SQL + """
SELECT InvoiceNo, ReservationID, CustomerID, AmountPayable, AmountPaid FROM good
WHERE CAST(InvoiceNo AS VARCHAR) NOT IN (SELECT row_key FROM violations WHERE row_key IS NOT NULL)
""")(lambda c: _invoice_load(c)[0])

register("loaded_invoice_violations", _INVOICE_LOAD_SQL + """
SELECT 'invoice' AS table_name, rule, CAST(column_name AS VARCHAR) AS column_name, CAST(row_key AS VARCHAR) AS row_key, bad_value FROM violations
""")(lambda c: _invoice_load(c)[1])


def customer_lines(T_) -> DataFrame:
    """Customers as JSON: names too long, phones that are numbers, names that are missing, objects cut short."""
    k = F.col("CustomerID")
    row = F.struct(
        "CustomerID", F.when(k % 29 == 0, F.repeat(F.col("CustomerFName"), F.lit(4))).otherwise(F.col("CustomerFName")).alias("CustomerFName"),
        F.when(k % 23 != 0, F.col("CustomerLName")).alias("CustomerLName"), "PhoneNumber",
    )
    text = F.to_json(row)
    return T_["customer"].select(F.when(k % 19 == 0, F.substring(text, 1, 30)).otherwise(text).alias("line"))


_CUSTOMER_LOAD_SQL = """
WITH lines AS (
  SELECT CustomerID AS k, '{"CustomerID":' || CustomerID || ',"CustomerFName":"'
         || CASE WHEN CustomerID % 29 = 0 THEN repeat(CustomerFName, 4) ELSE CustomerFName END || '"'
         || CASE WHEN CustomerID % 23 <> 0 THEN ',"CustomerLName":"' || CustomerLName || '"' ELSE '' END
         || ',"PhoneNumber":"' || PhoneNumber || '"}' AS whole FROM hotel_customer),
cut AS (SELECT CASE WHEN k % 19 = 0 THEN substr(whole, 1, 30) ELSE whole END AS line FROM lines),
good AS (
  SELECT CAST(line ->> 'CustomerID' AS BIGINT) AS CustomerID, line ->> 'CustomerFName' AS CustomerFName,
         line ->> 'CustomerLName' AS CustomerLName, line ->> 'PhoneNumber' AS PhoneNumber
  FROM cut WHERE json_valid(line)),
violations AS (
  SELECT 'unreadable' AS rule, NULL AS column_name, NULL AS row_key, line AS bad_value FROM cut WHERE NOT json_valid(line)
  UNION ALL SELECT 'not_null', 'CustomerLName', CAST(CustomerID AS VARCHAR), NULL FROM good WHERE CustomerLName IS NULL
  UNION ALL SELECT 'size', 'CustomerFName', CAST(CustomerID AS VARCHAR), CustomerFName FROM good WHERE length(CustomerFName) > 20
  UNION ALL SELECT 'size', 'CustomerLName', CAST(CustomerID AS VARCHAR), CustomerLName FROM good WHERE length(CustomerLName) > 20)
"""


def _customer_load(c: Context):
    return tables.load_lines(customer_lines(c.T), "customer", fmt="json", id_type=T.LongType())


register("loaded_customers", _CUSTOMER_LOAD_SQL + """
SELECT CustomerID, CustomerFName, CustomerLName, PhoneNumber FROM good
WHERE CAST(CustomerID AS VARCHAR) NOT IN (SELECT row_key FROM violations WHERE row_key IS NOT NULL)
""")(lambda c: _customer_load(c)[0])

register("loaded_customer_violations", _CUSTOMER_LOAD_SQL + """
SELECT 'customer' AS table_name, rule, CAST(column_name AS VARCHAR) AS column_name, CAST(row_key AS VARCHAR) AS row_key, bad_value FROM violations
""")(lambda c: _customer_load(c)[1])


# ======================================================== A3 change requests as JSON text


def payment_lines(T_) -> DataFrame:
    """Payments as JSON: numbers as text, invoice numbers as numbers, amounts too wide or missing, requests cut short or no object."""
    k = F.col("InvoiceNo")
    seq = F.when(k % 37 == 0, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k.cast("string"))
    number = F.when(k % 5 == 0, k.cast("string")).otherwise(F.concat(F.lit('"'), k, F.lit('"')))
    amount = F.when(k % 41 == 0, '"much"').when(k % 43 == 0, "99999999999.5").when(k % 47 == 0, "-3").when(k % 11 == 0, "null")
    amount = amount.otherwise(F.concat((k % 900).cast("string"), F.lit(".5")))
    line = F.concat(F.lit('{"change_seq": '), seq, F.lit(', "invoice_no": '), number, F.lit(', "amount": '), amount, F.lit("}"))
    line = F.when(k % 31 == 0, F.substring(line, 1, 25)).when(k % 53 == 0, F.concat(F.lit("["), line, F.lit("]"))).otherwise(line)
    return T_["invoice"].select(line.alias("line"))


_PAYMENT_LINES_SQL = """
WITH lines AS (
  SELECT InvoiceNo AS k, '{"change_seq": ' || CASE WHEN InvoiceNo % 37 = 0 THEN '"' || InvoiceNo || '"' ELSE CAST(InvoiceNo AS VARCHAR) END
         || ', "invoice_no": ' || CASE WHEN InvoiceNo % 5 = 0 THEN CAST(InvoiceNo AS VARCHAR) ELSE '"' || InvoiceNo || '"' END || ', "amount": '
         || CASE WHEN InvoiceNo % 41 = 0 THEN '"much"' WHEN InvoiceNo % 43 = 0 THEN '99999999999.5' WHEN InvoiceNo % 47 = 0 THEN '-3'
                 WHEN InvoiceNo % 11 = 0 THEN 'null' ELSE (InvoiceNo % 900) || '.5' END || '}' AS whole
  FROM hotel_invoice),
sent AS (SELECT CASE WHEN k % 31 = 0 THEN substr(whole, 1, 25) WHEN k % 53 = 0 THEN '[' || whole || ']' ELSE whole END AS raw FROM lines),
judged AS (
  SELECT raw, CASE WHEN NOT json_valid(raw) THEN 'malformed record'
                   WHEN json_type(raw) <> 'OBJECT' THEN 'malformed record'
                   WHEN json_type(raw, '$.change_seq') NOT IN ('BIGINT', 'UBIGINT', 'NULL') THEN 'type: change_seq'
                   WHEN raw ->> 'amount' IS NOT NULL AND TRY_CAST(raw ->> 'amount' AS DECIMAL(12,2)) IS NULL THEN 'type: amount' END AS reason
  FROM sent),
good AS (
  SELECT CAST(raw ->> 'change_seq' AS BIGINT) AS change_seq, raw ->> 'invoice_no' AS invoice_no,
         CAST(raw ->> 'amount' AS DECIMAL(12,2)) AS amount, raw AS body
  FROM judged WHERE reason IS NULL)
"""


def _payment_requests(c: Context):
    return tables.parse_changes(payment_lines(c.T), C.FEEDS["record_payments"], keep_body=True)


register("ingested_payments", _PAYMENT_LINES_SQL + """
SELECT change_seq, invoice_no, amount, body FROM good
""")(lambda c: _payment_requests(c)[0])

register("ingested_payment_bad_records", _PAYMENT_LINES_SQL + """
SELECT raw, reason FROM judged WHERE reason IS NOT NULL
""")(lambda c: _payment_requests(c)[1])

# the job's rejects show each request as it was sent: an invoice number as JSON number or text
register("ingested_payment_rejects", _PAYMENT_LINES_SQL + f"""
SELECT change_seq, invoice_no, amount, body, '{C.BAD_PAYMENT}' AS reason FROM good WHERE amount IS NULL OR amount <= 0
""")(lambda c: C.record_payments(c.T, _payment_requests(c)[0])[1])


# ============================================================= A4 result rows as JSON text

register("outstanding_invoices_json", """
SELECT '{"InvoiceNo":' || i.InvoiceNo || ',"CustomerID":' || i.CustomerID || ',"CustomerName":' || to_json(c.CustomerFName || ' ' || c.CustomerLName)
       || ',"ReservationID":' || COALESCE(CAST(i.ReservationID AS VARCHAR), 'null') || ',"AmountPayable":' || i.AmountPayable
       || ',"AmountPaid":' || i.AmountPaid || ',"BalanceDue":' || (i.AmountPayable - i.AmountPaid) || '}' AS line
FROM hotel_invoice i JOIN hotel_customer c USING (CustomerID) WHERE i.AmountPaid < i.AmountPayable
""")(lambda c: tables.report_lines(views.outstanding_invoices(c.T)))

register("reservation_list_json", """
SELECT '{"ReservationID":' || r.ReservationID || ',"RoomID":' || r.RoomID || ',"CustomerID":' || r.CustomerID
       || ',"CustomerName":' || to_json(c.CustomerFName || ' ' || c.CustomerLName) || ',"StaffID":' || r.StaffID
       || ',"CheckIn":"' || strftime(r.CheckIn, '%Y-%m-%d %H:%M:%S') || '","CheckOut":'
       || COALESCE('"' || strftime(r.CheckOut, '%Y-%m-%d %H:%M:%S') || '"', 'null') || '}' AS line
FROM hotel_reservation r JOIN hotel_customer c USING (CustomerID)
""")(lambda c: tables.report_lines(views.reservation_list(c.T)))
