"""Scalar functions (H1-H16) as JVM-side Column expressions.

None of these needs a Python UDF: each is a composition of built-in
functions, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from ..sources.schema import MONEY, REQUEST_STATUSES

# --- fixed values: display texts ----------------------------------------------
CURRENCY_PREFIX = "GH₵ "
DASH = "—"
UNASSIGNED = "Unassigned"
FULLY_PAID = "Fully Paid"
OPEN_INVOICE = "Record Payment"
STAY_ACTIVE = "Stay Active"
CHECKED_OUT = "Checked out"
STAR_FULL = "★"
STAR_EMPTY = "☆"
GUEST_STATUS_TEXT = {"Pending": "Pending Review", "Approved": "Approved & Confirmed", "Declined": "Declined"}
# --- end of fixed values ------------------------------------------------------

TAX_RATE = "0.125"
CHARGE_FACTOR = 1.125
DEFAULT_NIGHTLY_RATE = 100.0
HALF_DAY_SECONDS = 12 * 3600
DAY_MICROS = 86_400_000_000
_TWO_62 = 1 << 62
_TWO_61 = 1 << 61


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def full_name(first, last) -> Column:
    """H1: ``first || ' ' || last``; NULL if either part is NULL."""
    return F.concat(_c(first), F.lit(" "), _c(last))


def room_tax(rate) -> Column:
    """H2: rate x 0.125 as decimal(10,2); exact decimal product, half-up."""
    return (_c(rate) * F.lit(TAX_RATE).cast("decimal(4,3)")).cast(MONEY)


def stay_nights(check_in, check_out) -> Column:
    """H3: whole days, plus one when the rest is more than 12 h; at least 1.

    The difference is taken on the zone-less values (``timestamp_diff`` in
    microseconds), as the model subtracts naive datetimes: a stay across a
    clock change has the same nights in every session time zone.  A floor
    division keeps stays of any length or sign equal to calendar subtraction.
    """
    diff = F.timestamp_diff("MICROSECOND", _c(check_in), _c(check_out))
    rest = F.pmod(diff, F.lit(DAY_MICROS))
    days = (diff - rest).cast("long") / F.lit(DAY_MICROS)
    rest_seconds = F.floor(rest / F.lit(1_000_000))
    nights = days.cast("long") + F.when(rest_seconds > HALF_DAY_SECONDS, 1).otherwise(0)
    return F.greatest(F.lit(1).cast("long"), nights)


def round_half_even_binary(p) -> Column:
    """Round a non-negative double to cents, half to even on its exact binary value.

    Equal to Python's ``round(p, 2)``.  NULL when a DECIMAL(10,2) can't hold it.  Integer arithmetic: the fraction of
    ``p`` times 2^62 is an exact integer for every ``p >= 2^-10`` (its last
    bit is no finer than 2^-62), and fits a long; the hundredfold of it is
    carried in decimal(38,0), so nothing is rounded before the tie test.
    """
    p = _c(p)
    whole = F.floor(p).cast("long")
    z = ((p - F.floor(p)) * F.lit(float(_TWO_62))).cast("long").cast("decimal(38,0)") * F.lit(100)
    scale = F.lit(_TWO_62).cast("decimal(38,0)")
    r = F.pmod(z, scale)
    q = whole * 100 + ((z - r) / scale).cast("long")
    half = F.lit(_TWO_61).cast("decimal(38,0)")
    up = (r > half) | ((r == half) & (q % 2 == 1))
    cents = q + F.when(up, 1).otherwise(0)
    return (cents.cast("decimal(20,0)") / 100).try_cast(MONEY)


def stay_charge(nights, rate) -> Column:
    """H4: round(nights x rate x 1.125, 2) in binary floating point, half even.

    A missing or zero rate bills the default nightly rate.
    """
    r = _c(rate).cast("double")
    r = F.when(r.isNull() | (r == 0), F.lit(DEFAULT_NIGHTLY_RATE)).otherwise(r)
    product = (_c(nights).cast("double") * r) * F.lit(CHARGE_FACTOR).cast("double")
    return round_half_even_binary(product)


def balance_due(payable, paid) -> Column:
    """H5."""
    return _c(payable) - _c(paid)


def payment_state(payable, paid) -> Column:
    """H6: fully paid when paid >= payable."""
    return F.when(_c(paid) >= _c(payable), FULLY_PAID).otherwise(OPEN_INVOICE)


def stay_state(check_out) -> Column:
    """H7."""
    return F.when(_c(check_out).isNull(), STAY_ACTIVE).otherwise(CHECKED_OUT)


def rating_stars(rating) -> Column:
    """H8: filled stars for the rating, hollow ones up to five."""
    r = _c(rating).cast("int")
    return F.concat(F.repeat(F.lit(STAR_FULL), r), F.repeat(F.lit(STAR_EMPTY), F.lit(5) - r))


def money_label(amount) -> Column:
    """H9: currency prefix and two decimals; NULL shows a dash."""
    text = _c(amount).cast("decimal(38,2)").cast("string")
    return F.coalesce(F.concat(F.lit(CURRENCY_PREFIX), text), F.lit(DASH))


def request_label(status, room_no, audience: str = "guest") -> Column:
    """Request status as shown to a guest or to staff."""
    s = _c(status)
    if audience == "guest":
        return (
            F.when(s == "Approved", GUEST_STATUS_TEXT["Approved"])
            .when(s == "Declined", GUEST_STATUS_TEXT["Declined"])
            .otherwise(GUEST_STATUS_TEXT["Pending"])
        )
    return (
        F.when(s == "Pending", "Pending")
        .when(s == "Approved", F.concat(F.lit("Approved (Room "), _c(room_no).cast("string"), F.lit(")")))
        .otherwise("Declined")
    )


def default_label(value, default: str = DASH, falsy: bool = True) -> Column:
    """A missing value shows a default text (a dash, or ``Unassigned``).

    ``falsy=True`` is the front end's ``value || default`` (an empty text
    counts as missing too); ``falsy=False`` is ``value !== null ? value :
    default`` (only NULL), used for the floor, where 0 is shown.
    """
    text = _c(value).cast("string")
    if falsy:
        text = F.when(text != "", text)
    return F.coalesce(text, F.lit(default))


# whitespace as Python's str.split / str.strip see it: Unicode white space
# plus the four ASCII information separators
_WS = r"(?U)[\s\x1c-\x1f]"
# whitespace as JavaScript's String.trim sees it: Unicode white space and
# line terminators, the byte-order mark, but not NEL (U+0085)
_JS_WS = r"(?U)[[\s\uFEFF]&&[^\x85]]"


def py_strip(text) -> Column:
    """Python's ``str.strip()``."""
    return F.regexp_replace(_c(text), f"^{_WS}+|{_WS}+$", "")


def js_trim(text) -> Column:
    """JavaScript's ``String.prototype.trim()``."""
    return F.regexp_replace(_c(text), f"^{_JS_WS}+|{_JS_WS}+$", "")


def split_name(full) -> tuple[Column, Column]:
    """``full.split(None, 1)``: the first token, and the rest ('' if none).

    Leading white space is dropped; the rest keeps its trailing white space,
    as Python's split does with a maximum of one split.
    """
    head = F.regexp_replace(_c(full), "^" + _WS + "+", "")
    parts = F.split(head, _WS + "+", 2)
    return F.element_at(parts, 1), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))


def normalise_token(token) -> Column:
    """``token.trim().toUpperCase()``."""
    return F.upper(js_trim(token))


COLLATION = "UNICODE_CI_AI"


def contains_item(text, item: str) -> Column:
    """Substring test under the model's collation (its ``LIKE '%item%'``).

    Upper and lower case, accents and their absence, and spellings such as ß and
    ss are equal, as Spark's ``UNICODE_CI_AI`` compares text.
    """
    return F.contains(F.collate(_c(text), COLLATION), F.collate(F.lit(item), COLLATION))


def status_rank(status, order: Iterable[str] = REQUEST_STATUSES) -> Column:
    """1-based position in a list, 0 when absent (like ``FIELD``)."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), _c(status))


def is_missing(c: Column, dtype: str | None = None) -> Column:
    """Python truthiness of a JSON value: NULL, empty string or numeric zero.

    ``dtype`` is ``"string"`` (default), ``"number"`` or ``"other"`` (dates,
    timestamps: only NULL counts as missing).
    """
    if dtype in ("string", None):
        return c.isNull() | (c.cast("string") == "")
    if dtype == "other":
        return c.isNull()
    return c.isNull() | (c == 0)


def kind_of(dt) -> str:
    """The truthiness class of a Spark data type, for :func:`required_fields`."""
    from pyspark.sql import types as T

    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, T.NumericType):
        return "number"
    return "other"


def required_fields(columns: dict[str, str]) -> Column:
    """True when any listed column is missing (name -> simple type)."""
    cond = F.lit(False)
    for name, dtype in columns.items():
        cond = cond | is_missing(F.col(name), dtype)
    return cond
