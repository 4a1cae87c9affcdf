"""Newest row per vehicle."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadledger.functions.arguments import within
from roadledger.operators.filters import for_keys, lookback

VEHICLE = ("fleet_id", "vehicle_id")


def newest_per_vehicle(events: DataFrame) -> DataFrame:
    """The whole newest event of each vehicle; equal times are settled by the larger id.

    The rank filter becomes a group limit below the shuffle, so every task sends one row per
    vehicle however many events a vehicle has.
    """
    newest_first = Window.partitionBy(*VEHICLE).orderBy(F.desc("recorded_at"), F.desc("id"))
    return (
        events.withColumn("_rank", F.row_number().over(newest_first))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def latest_events(events: DataFrame, fleet_id: Any = None) -> DataFrame:
    """Where each vehicle is now."""
    columns = ("speed", "latitude", "longitude", "battery_level", "recorded_at")
    narrow = for_keys(events, fleet_id).select("id", *VEHICLE, *columns)
    return newest_per_vehicle(narrow).select(*VEHICLE, *columns)


def low_battery_vehicles(
    events: DataFrame, fleet_id: Any = None, threshold: int = 20
) -> DataFrame:
    """Newest event below the threshold per vehicle, even if it has recharged since."""
    within("threshold", threshold, 1, 100)
    columns = ("battery_level", "recorded_at", "latitude", "longitude")
    low = for_keys(events, fleet_id).filter(F.col("battery_level") < threshold)
    return newest_per_vehicle(low.select("id", *VEHICLE, *columns)).select(
        *VEHICLE,
        "battery_level",
        F.col("recorded_at").alias("last_seen"),
        "latitude",
        "longitude",
    )


def latest_overspeed(
    events: DataFrame,
    fleet_id: Any = None,
    threshold: int = 200,
    lookback_minutes: int = 5,
    as_of: datetime | None = None,
) -> DataFrame:
    """Newest event above the threshold per vehicle within the lookback."""
    columns = ("speed", "recorded_at", "latitude", "longitude")
    recent = lookback(for_keys(events, fleet_id), as_of, minutes=lookback_minutes)
    fast = recent.filter(F.col("speed") > threshold)
    return newest_per_vehicle(fast.select("id", *VEHICLE, *columns))
