"""Hourly statistics per vehicle."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadledger.functions.arguments import utc, within
from roadledger.functions.expressions import hour_of, mean_of
from roadledger.operators.filters import for_keys, hour_slice, lookback

BUCKET = ("fleet_id", "vehicle_id", "hour_bucket")
MEASURES = ("avg_speed", "max_speed", "min_battery", "event_count")


def _by_hour(events: DataFrame):
    return events.withColumn("hour_bucket", hour_of()).groupBy(*BUCKET)


def hourly_stats(
    events: DataFrame,
    fleet_id: Any = None,
    vehicle_id: Any = None,
    hours: int | None = 24,
    as_of: datetime | None = None,
) -> DataFrame:
    """Mean and top speed and event count per vehicle and UTC hour.

    ``hours=None`` takes the whole table. The result is sorted newest first for one vehicle;
    over all vehicles a total order would cost a shuffle nobody reads.
    """
    chosen = for_keys(events, fleet_id, vehicle_id)
    if hours is not None:
        chosen = lookback(chosen, as_of, hours=within("hours", hours, 1, 168))
    stats = _by_hour(chosen).agg(
        mean_of("speed").alias("avg_speed"),
        F.max("speed").alias("max_speed"),
        F.count("*").alias("event_count"),
    )
    return stats.orderBy(F.desc("hour_bucket")) if vehicle_id is not None else stats


def chart_series(stats: DataFrame) -> DataFrame:
    """Oldest first with missing measures as zero, as a line chart wants them."""
    zero = F.lit(0).cast("decimal(6,2)")
    return stats.withColumns(
        {
            "avg_speed": F.coalesce("avg_speed", zero),
            "max_speed": F.coalesce("max_speed", zero),
        }
    ).orderBy("fleet_id", "vehicle_id", "hour_bucket")


def rollup_rows(events: DataFrame, computed_at: datetime | None = None) -> DataFrame:
    """Rows of the hourly table for every bucket that has events."""
    measured = _by_hour(events).agg(
        mean_of("speed").alias("avg_speed"),
        F.max("speed").alias("max_speed"),
        F.min("battery_level").cast("smallint").alias("min_battery"),
        F.count("*").cast("int").alias("event_count"),
    )
    return as_rollup(measured, computed_at)


def as_rollup(measured: DataFrame, computed_at: datetime | None = None) -> DataFrame:
    """Measured buckets with the columns that the hourly table adds."""
    return measured.withColumns(
        {"computed_at": F.lit(utc(computed_at)), "bucket_date": F.to_date("hour_bucket")}
    )


def rollup_for_hour(events: DataFrame, hour: datetime, **keys: Any) -> DataFrame:
    """The rollup of one UTC hour; no row where there were no events."""
    return rollup_rows(hour_slice(for_keys(events, **keys), hour))


def read_rollup(
    rollup: DataFrame,
    fleet_id: Any = None,
    vehicle_id: Any = None,
    since: datetime | None = None,
) -> DataFrame:
    """Stored buckets from ``since`` on, newest first for one vehicle."""
    rows = for_keys(rollup, fleet_id, vehicle_id)
    if since is not None:
        first = utc(since)
        rows = rows.filter(F.col("hour_bucket") >= F.lit(first))
        if "bucket_date" in rows.columns:
            rows = rows.filter(F.col("bucket_date") >= F.lit(first.date()))
    rows = rows.select(*BUCKET, *MEASURES, "computed_at")
    return rows.orderBy(F.desc("hour_bucket")) if vehicle_id is not None else rows
