"""Manager reports and dashboard figures: aggregations.

Aggregations run as Spark's partial + final hash aggregates, so a hot key
is combined map-side before any shuffle.  Where a report joins a big fact
table to a dimension (D4, D5), the fact table is aggregated *first* and the
dimension is joined to one row per key.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import full_name
from ..sources.schema import MONEY, PERCENT

Tables = dict[str, DataFrame]


def _sort(df: DataFrame, ordered: bool, *cols) -> DataFrame:
    return df.orderBy(*cols) if ordered else df


def room_type_summary(T: Tables, ordered: bool = False) -> DataFrame:
    """Rooms and average rate (2 decimals, half up) per room type."""
    df = T["room"].groupBy("RoomType").agg(
        F.count(F.lit(1)).alias("TotalRooms"),
        F.round(F.avg("RoomRate"), 2).cast(MONEY).alias("AverageRate"),
    )
    return _sort(df, ordered, "RoomType")


def hall_hours_over(T: Tables, minimum=Decimal("2.0"), ordered: bool = False) -> DataFrame:
    """Hours booked per hall *name*, kept when above ``minimum``.

    Events are summed per HallID first (the join key), then the small
    per-hall totals are joined to the halls and re-summed by name.
    """
    per_hall = T["event"].groupBy("HallID").agg(F.sum("EventDuration").alias("hours"))
    df = (
        per_hall.join(T["conference_hall"].select("HallID", "HallName"), "HallID")
        .groupBy("HallName")
        .agg(F.sum("hours").cast("decimal(14,1)").alias("TotalHoursBooked"))
        .where(F.col("TotalHoursBooked") > F.lit(minimum))
    )
    return _sort(df, ordered, "HallName")


def room_inventory_report(T: Tables, ordered: bool = True) -> DataFrame:
    """D3: per room type: total, average rate, occupied and vacant counts."""
    status = F.col("RoomStatus")
    df = T["room"].groupBy("RoomType").agg(
        F.count(F.lit(1)).alias("TotalRooms"),
        F.round(F.avg("RoomRate"), 2).cast(MONEY).alias("AvgRate"),
        F.count_if(status == "Occupied").alias("OccupiedCount"),
        F.count_if(status == "Vacant").alias("VacantCount"),
    )
    return _sort(df, ordered, F.col("AvgRate").desc(), "RoomType")


def frontdesk_workload(T: Tables, ordered: bool = True) -> DataFrame:
    """Stays handled by each front-desk member, zero included."""
    handled = (
        T["reservation"]
        .where(F.col("ReservationID").isNotNull())
        .groupBy("StaffID")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    df = (
        T["staff"]
        .join(T["frontdesk"].select("StaffID", "Shift"), "StaffID")
        .join(handled, "StaffID", "left")
        .select(
            "StaffID",
            full_name("StaffFName", "StaffLName").alias("StaffName"),
            "Shift",
            F.coalesce("n", F.lit(0).cast("bigint")).alias("ReservationsHandled"),
        )
    )
    return _sort(df, ordered, F.col("ReservationsHandled").desc(), "StaffID")


def hall_utilisation(T: Tables, ordered: bool = True) -> DataFrame:
    """Events and hours per hall; a hall without events has 0 and NULL hours."""
    per_hall = T["event"].groupBy("HallID").agg(
        F.count("EventID").alias("n"), F.sum("EventDuration").alias("hours")
    )
    df = T["conference_hall"].join(per_hall, "HallID", "left").select(
        "HallID",
        "HallName",
        "Capacity",
        F.coalesce("n", F.lit(0).cast("bigint")).alias("EventsHosted"),
        F.col("hours").cast("decimal(14,1)").alias("TotalHoursBooked"),
    )
    return _sort(df, ordered, F.col("TotalHoursBooked").desc_nulls_last(), "HallID")


def _pct_hundredths(part: Column, total: Column) -> Column:
    """round(part / total * 100, 2) x 100 as an exact integer, half up; 0 if total is 0."""
    return F.when(total == 0, F.lit(0).cast("bigint")).otherwise(
        F.floor((part * 20000 + total) / (2 * total)).cast("bigint")
    )


def _occupancy_counts(T: Tables) -> DataFrame:
    status = F.col("RoomStatus")
    return T["room"].agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "Occupied").alias("occupied"),
        F.count_if(status == "Vacant").alias("vacant"),
    )


def occupancy_rate(T: Tables) -> DataFrame:
    """Occupied share of all rooms in percent, decimal(5,2); 0 with no rooms."""
    h = _pct_hundredths(F.col("occupied"), F.col("total"))
    return _occupancy_counts(T).select((h.cast("decimal(7,0)") / 100).cast(PERCENT).alias("OccupiedPct"))


def dashboard_stats(T: Tables, as_of) -> DataFrame:
    """The four dashboard figures in one row.

    One conditional aggregate over ROOM; the upcoming-event count is a
    scalar subquery over EVENT (run once, no join).
    """
    upcoming = T["event"].where(F.col("EventDate") >= F.lit(as_of).cast("date")).select(F.count(F.lit(1))).scalar()
    h = _pct_hundredths(F.col("occupied"), F.col("total"))
    return _occupancy_counts(T).select(
        F.col("vacant").alias("unoccupied_rooms"),
        F.col("occupied").alias("occupied_rooms"),
        (h / F.lit(100.0)).alias("occupancy_rate"),
        upcoming.alias("upcoming_events_count"),
    )


def occupancy_split(T: Tables) -> DataFrame:
    """Occupied and vacant percent (vacant = 100 - occupied, 2 decimals)."""
    h = _pct_hundredths(F.col("occupied"), F.col("total"))
    return _occupancy_counts(T).select(
        (h / F.lit(100.0)).alias("occupied_pct"),
        ((F.lit(10000) - h) / F.lit(100.0)).alias("vacant_pct"),
    )
