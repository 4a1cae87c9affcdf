"""Fixed schemas of the stored tables and the raw landing rows.

``fleet_id``, ``vehicle_id`` and ``id`` are UUID strings in production; every operator
works with any key type, so the schema functions take it as an argument.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPEED = T.DecimalType(6, 2)
DEGREES = T.DecimalType(9, 6)
ACCELERATION = T.DecimalType(7, 3)
# Wide enough to hold a raw decimal before it is rounded to its stored scale.
RAW_DECIMAL = T.DecimalType(38, 18)
LABELS = T.ArrayType(T.StringType(), containsNull=False)

REQUIRED_FIELDS = (
    "fleet_id",
    "vehicle_id",
    "speed",
    "latitude",
    "longitude",
    "battery_level",
    "recorded_at",
)
OPTIONAL_FIELDS = ("acceleration", "weather", "engine_on")

# Derived partition columns of the event table.
EVENT_PARTITIONS = ("event_month", "event_date")


def core_events(key: T.DataType = T.StringType()) -> T.StructType:
    """Version 1 of the event table: the nine core columns."""
    return T.StructType(
        [
            T.StructField("id", key, False),
            T.StructField("recorded_at", T.TimestampType(), False),
            T.StructField("fleet_id", key, False),
            T.StructField("vehicle_id", key, False),
            T.StructField("speed", SPEED, False),
            T.StructField("latitude", DEGREES, False),
            T.StructField("longitude", DEGREES, False),
            T.StructField("battery_level", T.ShortType(), False),
            T.StructField("ingested_at", T.TimestampType(), False),
        ]
    )


def events(key: T.DataType = T.StringType()) -> T.StructType:
    """The current event table, without its partition columns."""
    return T.StructType(
        core_events(key).fields
        + [
            T.StructField("acceleration", ACCELERATION, True),
            T.StructField("weather", T.StringType(), True),
            T.StructField("engine_on", T.BooleanType(), True),
            T.StructField("scenarios", LABELS, False),
        ]
    )


def stored_events(key: T.DataType = T.StringType()) -> T.StructType:
    """The event table as laid out on disk, for stream readers that need it up front."""
    return T.StructType(
        events(key).fields
        + [
            T.StructField("event_month", T.StringType(), True),
            T.StructField("event_date", T.DateType(), True),
            T.StructField("ingest_batch", T.StringType(), True),
        ]
    )


def hourly(key: T.DataType = T.StringType()) -> T.StructType:
    return T.StructType(
        [
            T.StructField("fleet_id", key, False),
            T.StructField("vehicle_id", key, False),
            T.StructField("hour_bucket", T.TimestampType(), False),
            T.StructField("avg_speed", SPEED, True),
            T.StructField("max_speed", SPEED, True),
            T.StructField("min_battery", T.ShortType(), True),
            T.StructField("event_count", T.IntegerType(), False),
            T.StructField("computed_at", T.TimestampType(), False),
            T.StructField("bucket_date", T.DateType(), True),
        ]
    )


def fleets(key: T.DataType = T.StringType()) -> T.StructType:
    return T.StructType(
        [
            T.StructField("id", key, False),
            T.StructField("name", T.StringType(), False),
            T.StructField("api_key_hash", T.StringType(), False),
            T.StructField("created_at", T.TimestampType(), False),
            T.StructField("is_active", T.BooleanType(), False),
        ]
    )


def vehicles(key: T.DataType = T.StringType()) -> T.StructType:
    return T.StructType(
        [
            T.StructField("id", key, False),
            T.StructField("fleet_id", key, False),
            T.StructField("vin", T.StringType(), False),
            T.StructField("model", T.StringType(), True),
            T.StructField("created_at", T.TimestampType(), False),
        ]
    )


def alerts(key: T.DataType = T.StringType()) -> T.StructType:
    return T.StructType(
        [
            T.StructField("alert_id", T.StringType(), False),
            T.StructField("fleet_id", key, False),
            T.StructField("vehicle_id", key, False),
            T.StructField("alert_type", T.StringType(), False),
            T.StructField("severity", T.StringType(), False),
            T.StructField("payload", T.StringType(), False),
            T.StructField("acknowledged", T.BooleanType(), False),
            T.StructField("triggered_at", T.TimestampType(), False),
        ]
    )


def raw_event() -> T.StructType:
    """Landing rows: every field a string, typed later, because senders mix strings and numbers."""
    return T.StructType(
        [T.StructField(name, T.StringType(), True) for name in REQUIRED_FIELDS + OPTIONAL_FIELDS]
    )


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Fail before the plan is built when a needed column is missing."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df
