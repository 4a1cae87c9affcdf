"""Per-fleet summaries."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadledger.functions.arguments import utc
from roadledger.functions.expressions import battery_band, exact_mean
from roadledger.operators.filters import between, for_keys

# Fixed value: a vehicle was low on battery once it reported less than this.
SUMMARY_LOW_BATTERY = 20


def fleet_summary(
    events: DataFrame, fleet_id: Any = None, as_of: datetime | None = None
) -> DataFrame:
    """Vehicles seen, vehicles active and their mean speed in the last hour, vehicles ever low.

    Two levels of grouping give three distinct counts from one pass: per vehicle first, where a
    hot vehicle is folded map-side, then per fleet. Several ``count(DISTINCT)`` would multiply
    every event by three instead. One fleet always gives one row, also without events; over all
    fleets only fleets with events have one.
    """
    clock = utc(as_of)
    recent = F.col("recorded_at") >= F.lit(clock - timedelta(hours=1))
    per_vehicle = (
        for_keys(events, fleet_id)
        .groupBy("fleet_id", "vehicle_id")
        .agg(
            F.max(recent).alias("active"),
            F.max(F.col("battery_level") < SUMMARY_LOW_BATTERY).alias("low"),
            F.sum(F.when(recent, F.col("speed"))).alias("speed_sum"),
            F.count(F.when(recent, F.col("speed"))).alias("speed_count"),
        )
    )
    return _summed(per_vehicle, fleet_id, clock)


def summary_from_rollup(
    rollup: DataFrame, events: DataFrame, fleet_id: Any = None, as_of: datetime | None = None
) -> DataFrame:
    """The same summary from the stored rollup and the events of the last hour.

    The rollup has a row per vehicle and hour, with the lowest battery level; only what the last hour
    asks for comes from events, whose time bounds skip all other dates. Vehicles that the rollup
    does not know yet are counted from those events.
    """
    clock = utc(as_of)
    low = F.col("low") < SUMMARY_LOW_BATTERY
    stored = (
        for_keys(rollup, fleet_id).groupBy("fleet_id", "vehicle_id").agg(F.min("min_battery").alias("low"))
        .select("fleet_id", "vehicle_id", F.lit(False).alias("active"), low.alias("low"), F.lit(None).cast("decimal(16,2)").alias("speed_sum"), F.lit(0).cast("bigint").alias("speed_count"))
    )
    recent = (
        between(for_keys(events, fleet_id), start=clock - timedelta(hours=1)).groupBy("fleet_id", "vehicle_id")
        .agg(F.min("battery_level").alias("low"), F.sum("speed").alias("speed_sum"), F.count("speed").alias("speed_count"))
        .select("fleet_id", "vehicle_id", F.lit(True).alias("active"), low.alias("low"), "speed_sum", "speed_count")
    )
    per_vehicle = stored.unionByName(recent).groupBy("fleet_id", "vehicle_id").agg(
        F.max("active").alias("active"), F.max("low").alias("low"),
        F.sum("speed_sum").alias("speed_sum"), F.sum("speed_count").alias("speed_count"),
    )
    return _summed(per_vehicle, fleet_id, clock)


def _summed(per_vehicle: DataFrame, fleet_id: Any, clock: datetime) -> DataFrame:
    grouped = per_vehicle.groupBy() if fleet_id is not None else per_vehicle.groupBy("fleet_id")
    summary = grouped.agg(
        F.count("*").alias("total_vehicles"),
        F.count_if("active").alias("active_vehicles_last_hour"),
        F.sum("speed_sum").alias("speed_sum"),
        F.coalesce(F.sum("speed_count"), F.lit(0)).alias("speed_count"),
        F.count_if("low").alias("low_battery_count"),
    )
    key = F.lit(fleet_id) if fleet_id is not None else F.col("fleet_id")
    return summary.select(
        key.alias("fleet_id"),
        "total_vehicles",
        "active_vehicles_last_hour",
        exact_mean(F.col("speed_sum"), F.col("speed_count")).alias("avg_speed_last_hour"),
        "low_battery_count",
        F.lit(clock).alias("generated_at"),
    )


def vehicle_sketches(rollup: DataFrame) -> DataFrame:
    """One mergeable sketch of the vehicles per fleet and date, to store next to the rollup."""
    return rollup.groupBy("fleet_id", "bucket_date").agg(F.hll_sketch_agg("vehicle_id", 12).alias("vehicles"))


def sketched_vehicle_count(sketches: DataFrame) -> DataFrame:
    """Vehicles per fleet over any dates, from stored sketches (about 2 % standard error)."""
    merged = sketches.groupBy("fleet_id").agg(F.hll_union_agg("vehicles").alias("vehicles"))
    return merged.select("fleet_id", F.hll_sketch_estimate("vehicles").alias("vehicle_count"))


def vehicle_count(
    events: DataFrame, fleet_id: Any = None, approximate: bool = False
) -> DataFrame:
    """Vehicles with events per fleet, exactly or by sketch (about 5 % standard error)."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return (
        for_keys(events, fleet_id)
        .groupBy("fleet_id")
        .agg(count("vehicle_id").alias("vehicle_count"))
    )


def battery_bands(events: DataFrame, fleet_id: Any = None) -> DataFrame:
    """Events per fleet and battery band."""
    return (
        for_keys(events, fleet_id)
        .groupBy("fleet_id", battery_band().alias("battery_band"))
        .agg(F.count("*").alias("event_count"))
    )
