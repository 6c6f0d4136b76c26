"""Declared schema of the bookings tables and their constraint specs.

Each table is a :class:`TableSpec`: typed columns plus the rules the data
must satisfy (primary key, NOT NULL, value lists, ranges, VARCHAR sizes,
DECIMAL precision, foreign keys).  The same specs drive the typed readers
(:mod:`innkeep.sources.tables`) and the data-quality job
(:mod:`innkeep.operators.quality`).

Identifier columns (``is_id``) are strings in the declared model; tables
derived from the driver's numeric tables keep them as ``bigint``.  Every
operator in the library is agnostic to that choice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --- fixed values: allowed values of the enumerated columns -------------------
STAFF_ROLES = ("Housekeeping", "Front Desk")
SHIFTS = ("Morning", "Afternoon", "Evening")
ROOM_STATUSES = ("Occupied", "Vacant")
EVENT_TYPES = ("Wedding", "Conference", "Seminar", "Networking Event", "Birthday Party")
REQUEST_STATUSES = ("Pending", "Approved", "Declined")
# --- end of fixed values ------------------------------------------------------


@dataclass(frozen=True)
class Col:
    name: str
    dtype: T.DataType
    nullable: bool = False
    is_id: bool = False
    max_len: int | None = None
    values: tuple[str, ...] | None = None
    between: tuple[int, int] | None = None


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str
    on_delete: str  # "cascade" | "restrict" | "set null"


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[Col, ...]
    key: tuple[str, ...]
    foreign_keys: tuple[ForeignKey, ...] = field(default_factory=tuple)

    def col(self, name: str) -> Col:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(f"{self.name}.{name}")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def struct(self, id_type: T.DataType | None = None) -> T.StructType:
        """Spark schema; ``id_type`` overrides the type of identifier columns."""
        return T.StructType(
            [
                T.StructField(
                    c.name,
                    id_type if (c.is_id and id_type is not None) else c.dtype,
                    c.nullable,
                )
                for c in self.columns
            ]
        )


def _id(name: str, nullable: bool = False, size: int = 5) -> Col:
    return Col(name, T.StringType(), nullable=nullable, is_id=True, max_len=size)


def _s(name: str, size: int | None = None, nullable: bool = False) -> Col:
    return Col(name, T.StringType(), nullable=nullable, max_len=size)


MONEY = T.DecimalType(10, 2)
HOURS = T.DecimalType(4, 1)
PERCENT = T.DecimalType(5, 2)

STAFF = TableSpec(
    "staff",
    (
        _id("StaffID"),
        _s("StaffFName", 20),
        _s("StaffLName", 20),
        Col("StaffRole", T.StringType(), values=STAFF_ROLES),
    ),
    ("StaffID",),
)

HOUSEKEEPING = TableSpec(
    "housekeeping",
    (
        _id("StaffID"),
        Col("Shift", T.StringType(), values=SHIFTS),
        Col("AssignedFloor", T.IntegerType(), between=(0, 20)),
    ),
    ("StaffID",),
    (ForeignKey("StaffID", "staff", "StaffID", "cascade"),),
)

FRONTDESK = TableSpec(
    "frontdesk",
    (_id("StaffID"), Col("Shift", T.StringType(), values=SHIFTS)),
    ("StaffID",),
    (ForeignKey("StaffID", "staff", "StaffID", "cascade"),),
)

CUSTOMER = TableSpec(
    "customer",
    (
        _id("CustomerID"),
        _s("CustomerFName", 20),
        _s("CustomerLName", 20),
        _s("PhoneNumber", 10),
    ),
    ("CustomerID",),
)

CONFERENCE_HALL = TableSpec(
    "conference_hall",
    (_id("HallID"), _s("HallName", 50), Col("Capacity", T.IntegerType())),
    ("HallID",),
)

RESTAURANT = TableSpec(
    "restaurant",
    (_id("RestaurantID"), _s("RestaurantName", 50), Col("SeatingCapacity", T.IntegerType())),
    ("RestaurantID",),
)

ROOM = TableSpec(
    "room",
    (
        _id("RoomNo"),
        _s("RoomType", 30),
        Col("RoomRate", MONEY),
        Col("RoomStatus", T.StringType(), values=ROOM_STATUSES),
        _id("HousekeeperID", nullable=True),
    ),
    ("RoomNo",),
    (ForeignKey("HousekeeperID", "housekeeping", "StaffID", "set null"),),
)

RESERVATION = TableSpec(
    "reservation",
    (
        _id("ReservationID"),
        _id("RoomID"),
        _id("CustomerID"),
        _id("StaffID"),
        Col("CheckIn", T.TimestampNTZType()),
        Col("CheckOut", T.TimestampNTZType(), nullable=True),
    ),
    ("ReservationID",),
    (
        ForeignKey("RoomID", "room", "RoomNo", "restrict"),
        ForeignKey("CustomerID", "customer", "CustomerID", "restrict"),
        ForeignKey("StaffID", "frontdesk", "StaffID", "restrict"),
    ),
)

EVENT = TableSpec(
    "event",
    (
        _id("EventID"),
        Col("EventType", T.StringType(), values=EVENT_TYPES),
        Col("EventDate", T.DateType()),
        Col("EventDuration", HOURS),
        _id("Host"),
        _id("HallID"),
    ),
    ("EventID",),
    (
        ForeignKey("HallID", "conference_hall", "HallID", "restrict"),
        ForeignKey("Host", "customer", "CustomerID", "restrict"),
    ),
)

INVOICE = TableSpec(
    "invoice",
    (
        _id("InvoiceNo"),
        _id("ReservationID", nullable=True),
        _id("CustomerID"),
        Col("AmountPayable", MONEY),
        Col("AmountPaid", MONEY),
    ),
    ("InvoiceNo",),
    (
        ForeignKey("ReservationID", "reservation", "ReservationID", "set null"),
        ForeignKey("CustomerID", "customer", "CustomerID", "restrict"),
    ),
)

RESTAURANT_ORDER = TableSpec(
    "restaurant_order",
    (
        _id("OrderID"),
        _id("CustomerID"),
        _id("RestaurantID"),
        _id("InvoiceID", nullable=True),
        _s("OrderDetails"),
    ),
    ("OrderID",),
    (
        ForeignKey("CustomerID", "customer", "CustomerID", "restrict"),
        ForeignKey("RestaurantID", "restaurant", "RestaurantID", "restrict"),
        ForeignKey("InvoiceID", "invoice", "InvoiceNo", "set null"),
    ),
)

CUSTOMER_FEEDBACK = TableSpec(
    "customer_feedback",
    (
        _id("FeedbackID"),
        _id("CustomerID"),
        Col("Rating", T.IntegerType(), between=(1, 5)),
        _s("Comments"),
        Col("FeedbackDate", T.DateType()),
    ),
    ("FeedbackID",),
    (ForeignKey("CustomerID", "customer", "CustomerID", "cascade"),),
)

RESERVATION_REQUEST = TableSpec(
    "reservation_request",
    (
        _s("RequestToken", 6),
        _id("CustomerID"),
        _s("RoomType", 30),
        Col("CheckIn", T.TimestampNTZType()),
        Col("CheckOut", T.TimestampNTZType()),
        Col("Status", T.StringType(), values=REQUEST_STATUSES),
        _id("RoomNo", nullable=True),
        _id("StaffID", nullable=True),
        Col("RequestDate", T.DateType()),
    ),
    ("RequestToken",),
    (
        ForeignKey("CustomerID", "customer", "CustomerID", "cascade"),
        ForeignKey("RoomNo", "room", "RoomNo", "set null"),
        ForeignKey("StaffID", "frontdesk", "StaffID", "set null"),
    ),
)

SPECS: dict[str, TableSpec] = {
    s.name: s
    for s in (
        STAFF,
        HOUSEKEEPING,
        FRONTDESK,
        CUSTOMER,
        CONFERENCE_HALL,
        RESTAURANT,
        ROOM,
        RESERVATION,
        EVENT,
        INVOICE,
        RESTAURANT_ORDER,
        CUSTOMER_FEEDBACK,
        RESERVATION_REQUEST,
    )
}

TABLES = tuple(SPECS)
