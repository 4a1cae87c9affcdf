"""Overspeed alerts, one per vehicle while an earlier one is open."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadledger.functions.arguments import utc
from roadledger.operators.filters import for_keys, lookback, open_alerts
from roadledger.operators.latest import VEHICLE, latest_overspeed, newest_per_vehicle

# Fixed values of the alert log.
OVERSPEED = "OVERSPEED"
WARNING = "WARNING"
OVERSPEED_THRESHOLD = 200
CRITICAL_BATTERY = 10


def _as_alerts(found: DataFrame, alert_type: str, severity: str, clock: datetime) -> DataFrame:
    """Alert rows; the id follows from the event, so a repeated run names the same alert."""
    identity = F.concat_ws(
        "|", *[F.col(name).cast("string") for name in VEHICLE], F.lit(alert_type),
        F.col("id").cast("string"),
    )
    payload = F.to_json(
        F.struct("speed", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    )
    return found.select(
        F.sha2(identity, 256).alias("alert_id"),
        *VEHICLE,
        F.lit(alert_type).alias("alert_type"),
        F.lit(severity).alias("severity"),
        payload.alias("payload"),
        F.lit(False).alias("acknowledged"),
        F.lit(clock).alias("triggered_at"),
    )


def _without_open(found: DataFrame, alerts: DataFrame, alert_type: str, since: datetime):
    """Both sides hold a row per vehicle at most times; Spark picks the join by their size."""
    known = open_alerts(alerts, alert_type, since).select(*VEHICLE)
    return found.join(known, list(VEHICLE), "left_anti")


def new_overspeed_alerts(
    events: DataFrame,
    alerts: DataFrame,
    fleet_id: Any = None,
    lookback_minutes: int = 5,
    as_of: datetime | None = None,
    threshold: int = OVERSPEED_THRESHOLD,
) -> DataFrame:
    """Alerts to append: the newest overspeed event of each vehicle without an open alert.

    The lookback also bounds which alerts count as open, so a lasting condition is reported
    again once its alert is older than the lookback.
    """
    clock = utc(as_of)
    found = latest_overspeed(events, fleet_id, threshold, lookback_minutes, clock)
    since = clock - timedelta(minutes=lookback_minutes)
    return _as_alerts(_without_open(found, alerts, OVERSPEED, since), OVERSPEED, WARNING, clock)


def new_critical_battery_alerts(
    events: DataFrame,
    alerts: DataFrame,
    fleet_id: Any = None,
    lookback_minutes: int = 5,
    as_of: datetime | None = None,
    threshold: int = CRITICAL_BATTERY,
) -> DataFrame:
    """The same scan for battery levels below the critical threshold. Off unless called."""
    clock = utc(as_of)
    recent = lookback(for_keys(events, fleet_id), clock, minutes=lookback_minutes)
    low = recent.filter(F.col("battery_level") < threshold)
    columns = ("id", *VEHICLE, "speed", "recorded_at", "latitude", "longitude")
    found = newest_per_vehicle(low.select(*columns))
    since = clock - timedelta(minutes=lookback_minutes)
    kind = "CRITICAL_BATTERY"
    return _as_alerts(_without_open(found, alerts, kind, since), kind, WARNING, clock)
