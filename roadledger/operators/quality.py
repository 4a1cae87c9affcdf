"""Table checks: uniqueness, references, month coverage, cascade."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadledger.functions.arguments import utc, within

# The unique keys of the tables.
UNIQUE_KEYS = {
    "events": ("id", "recorded_at"),
    "vehicles": ("fleet_id", "vin"),
    "fleets": ("api_key_hash",),
    "hourly": ("fleet_id", "vehicle_id", "hour_bucket"),
}


def duplicates(table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return (
        table.groupBy(*key).agg(F.count("*").alias("row_count")).filter(F.col("row_count") > 1)
    )


def orphans(
    rows: DataFrame, fleets: DataFrame, column: str = "fleet_id", key: str = "id"
) -> DataFrame:
    """Rows whose fleet is not registered. A null reference is no violation."""
    known = fleets.select(F.col(key).alias(column))
    return rows.filter(F.col(column).isNotNull()).join(known, column, "left_anti")


def orphan_counts(events: DataFrame, fleets: DataFrame) -> DataFrame:
    """Events per unregistered fleet. Counting first leaves one row per fleet to join."""
    per_fleet = events.groupBy("fleet_id").agg(F.count("*").alias("event_count"))
    return orphans(per_fleet, fleets)


def without_fleets(vehicles: DataFrame, deleted: DataFrame, key: str = "id") -> DataFrame:
    """The vehicle table after deleting fleets: their vehicles go with them."""
    gone = deleted.select(F.col(key).alias("fleet_id"))
    return vehicles.join(gone, "fleet_id", "left_anti").select(*vehicles.columns)


def month_coverage(
    events: DataFrame,
    as_of: datetime | None = None,
    months_back: int = 1,
    months_ahead: int = 3,
) -> DataFrame:
    """Months of the window around ``as_of`` with their bounds and whether they hold events.

    On a partitioned table only the month column is read.
    """
    within("months_back", months_back, 0)
    within("months_ahead", months_ahead, 0)
    first = F.trunc(F.lit(utc(as_of).date()), "month")
    months = events.sparkSession.range(-months_back, months_ahead + 1).select(
        F.add_months(first, F.col("id").cast("int")).alias("month_start")
    )
    window = months.select(
        F.date_format("month_start", "yyyy-MM").alias("event_month"),
        "month_start",
        F.add_months("month_start", 1).alias("month_end"),
        F.date_format("month_start", "yyyy_MM").alias("month_label"),
    )
    present = events.groupBy("event_month").agg(F.lit(True).alias("present"))
    return window.join(present, "event_month", "left").select(
        *window.columns, F.coalesce("present", F.lit(False)).alias("has_events")
    )


def missing_months(coverage: DataFrame) -> DataFrame:
    return coverage.filter(~F.col("has_events")).drop("has_events")
