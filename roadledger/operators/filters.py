"""Row filters. Time bounds also bound the partition columns, which Spark cannot infer."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger.functions.arguments import utc
from roadledger.functions.rules import check_label
from roadledger.schemas import LABELS


def for_keys(df: DataFrame, fleet_id: Any = None, vehicle_id: Any = None) -> DataFrame:
    """One fleet, one vehicle, or (with None) all of them."""
    if fleet_id is not None:
        df = df.filter(F.col("fleet_id") == F.lit(fleet_id))
    if vehicle_id is not None:
        df = df.filter(F.col("vehicle_id") == F.lit(vehicle_id))
    return df


def between(
    events: DataFrame, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Events with ``start <= recorded_at < end``; each bound is optional.

    Where the table carries ``event_month`` / ``event_date`` the same bounds are put on them,
    so that only the matching directories are listed and read.
    """
    if start is not None:
        first = utc(start)
        events = events.filter(F.col("recorded_at") >= F.lit(first))
        if "event_month" in events.columns:
            events = events.filter(F.col("event_month") >= first.strftime("%Y-%m"))
        if "event_date" in events.columns:
            events = events.filter(F.col("event_date") >= F.lit(first.date()))
    if end is not None:
        stop = utc(end)
        last = stop - timedelta(microseconds=1)
        events = events.filter(F.col("recorded_at") < F.lit(stop))
        if "event_month" in events.columns:
            events = events.filter(F.col("event_month") <= last.strftime("%Y-%m"))
        if "event_date" in events.columns:
            events = events.filter(F.col("event_date") <= F.lit(last.date()))
    return events


def lookback(events: DataFrame, as_of: datetime | None = None, **delta: int) -> DataFrame:
    """Events from ``as_of - delta`` on, inclusive; the oldest bucket may be partial."""
    return between(events, start=utc(as_of) - timedelta(**delta))


def hour_slice(events: DataFrame, hour: datetime) -> DataFrame:
    """Events of one UTC hour."""
    start = utc(hour).replace(minute=0, second=0, microsecond=0)
    return between(events, start, start + timedelta(hours=1))


def has_label(label: str) -> Column:
    return F.array_contains("scenarios", label)


def has_all_labels(wanted: Iterable[str]) -> Column:
    """Containment of a whole label list."""
    wanted_array = F.array(*[F.lit(label) for label in wanted]).cast(LABELS)
    return F.size(F.array_except(wanted_array, F.col("scenarios"))) == 0


def tagged(events: DataFrame) -> DataFrame:
    """Events with at least one label."""
    return events.filter(F.size("scenarios") > 0)


def labelled(
    events: DataFrame,
    label: str,
    fleet_id: Any = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Events carrying a known label, for one fleet or all, in a half-open time range."""
    check_label(label)
    return between(for_keys(events, fleet_id), start, end).filter(has_label(label))


def open_alerts(alerts: DataFrame, alert_type: str, since: datetime) -> DataFrame:
    """Unacknowledged alerts of a type triggered at or after ``since``."""
    return alerts.filter(
        (F.col("alert_type") == alert_type)
        & ~F.col("acknowledged")
        & (F.col("triggered_at") >= F.lit(utc(since)))
    )
