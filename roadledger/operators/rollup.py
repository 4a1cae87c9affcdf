"""Keeping the hourly rollup up to date with newly arrived events."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger.functions.expressions import hour_of
from roadledger.operators.hourly import BUCKET, rollup_rows


def affected_buckets(new_events: DataFrame) -> DataFrame:
    """The vehicle hours that new events fall into, each once."""
    return new_events.select("fleet_id", "vehicle_id", hour_of().alias("hour_bucket")).distinct()


def in_hours(hours: Iterable[datetime], dated: bool) -> Column:
    """Times inside any of the hours, with the partition dates so that other folders are skipped.

    Both are sets looked up by hash, whatever their number; the outer bounds reach the file scan.
    """
    hours = sorted(hours)
    if not hours:
        return F.lit(False)
    moment = F.col("recorded_at")
    wanted = (moment >= F.lit(hours[0])) & (moment < F.lit(hours[-1] + timedelta(hours=1)))
    wanted &= F.floor(F.unix_seconds(moment) / 3600).isin([int(hour.timestamp()) // 3600 for hour in hours])
    if dated:
        wanted &= F.col("event_date").isin(sorted({hour.date() for hour in hours}))
    return wanted


def recompute(
    events: DataFrame, affected: DataFrame, computed_at: datetime | None = None
) -> DataFrame:
    """Fresh rollup rows of the affected buckets, from all events of those buckets.

    The touched hours, at most 24 per day, come to the driver to bound the scan. Events are
    aggregated before the buckets are matched, so a crowded bucket is folded map-side and only
    finished rollup rows are joined.
    """
    rows = affected.select(F.unix_seconds("hour_bucket")).distinct().collect()
    hours = [datetime.fromtimestamp(row[0], timezone.utc) for row in rows]
    touched = events.filter(in_hours(hours, "event_date" in events.columns))
    return rollup_rows(touched, computed_at).join(affected, list(BUCKET), "left_semi")
