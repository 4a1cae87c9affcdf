"""Periodic alert scan over the event table."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadledger import schemas
from roadledger.functions.arguments import utc
from roadledger.operators.alerts import new_overspeed_alerts
from roadledger.sources.events import read_dimension, read_events
from roadledger.sources.tables import append_rows


def scan_for_alerts(
    spark: SparkSession,
    events_path: str,
    alerts_path: str,
    fleet_id: Any = None,
    lookback_minutes: int = 5,
    as_of: datetime | None = None,
    key: T.DataType = T.StringType(),
) -> int:
    """Append new overspeed alerts to the log and return how many there were.

    A scan that is run again for the same time adds nothing: the alerts of the first run are open.
    """
    clock = utc(as_of)
    events = read_events(spark, events_path)
    known = read_dimension(spark, alerts_path, schemas.alerts(key))
    found = new_overspeed_alerts(events, known, fleet_id, lookback_minutes, clock)
    written = Observation("alerts")
    append_rows(found.observe(written, F.count(F.lit(1)).alias("created")), alerts_path)
    return written.get["created"]
