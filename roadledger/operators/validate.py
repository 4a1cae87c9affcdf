"""Ingest checks: type the raw string rows, give every defect a reason code, split.

All checks are column expressions over one pass; a row keeps all its reasons.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger.functions.arguments import utc
from roadledger.functions.expressions import ZONED, instant_of
from roadledger.functions.rules import RULES, Rule, detect
from roadledger.schemas import (
    ACCELERATION,
    DEGREES,
    OPTIONAL_FIELDS,
    RAW_DECIMAL,
    REQUIRED_FIELDS,
    SPEED,
    require_columns,
)

# Accepted ranges (inclusive), decimals, text length and clock tolerance.
RANGES = {"speed": (0, 500), "latitude": (-90, 90), "longitude": (-180, 180)}
DECIMALS = {"speed": 2, "latitude": 6, "longitude": 6}
BATTERY_RANGE = (0, 100)
WEATHER_LENGTH = 64
FUTURE_SECONDS = 300
# Reason code prefixes where they differ from the field name.
CODES = {"latitude": "lat", "longitude": "lon", "battery_level": "battery", "engine_on": "engine"}

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
_LOOSE_UUID = (
    r"^(?:urn:uuid:)?\{?([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})\}?$"
)
_TRUE = ("true", "t", "yes", "y", "on", "1")
_FALSE = ("false", "f", "no", "n", "off", "0")


def _code(field: str) -> str:
    return CODES.get(field, field)


def _value(field: str) -> Column:
    """The typed value of a raw field, kept under its own name next to the text."""
    return F.col(f"typed_{field}")


def _uuid(field: str) -> Column:
    """Lower case with hyphens; other accepted spellings are brought to that form."""
    text = F.lower(F.trim(F.col(field)))
    spelled_out = F.regexp_replace(text, _LOOSE_UUID, "$1-$2-$3-$4-$5")
    return F.when(text.rlike(_UUID), text).when(text.rlike(_LOOSE_UUID), spelled_out)


def _flag(field: str) -> Column:
    text = F.lower(F.trim(F.col(field)))
    return F.when(text.isin(*_TRUE), True).when(text.isin(*_FALSE), False)


def typed(raw: DataFrame, uuid_keys: bool = True) -> DataFrame:
    """Add a ``typed_`` column per field; unreadable text becomes null."""
    require_columns(raw, REQUIRED_FIELDS)
    absent = [name for name in OPTIONAL_FIELDS if name not in raw.columns]
    raw = raw.withColumns({name: F.lit(None).cast("string") for name in absent})
    numbers = ("speed", "latitude", "longitude", "battery_level", "acceleration")
    key = _uuid if uuid_keys else F.col
    values = {name: F.trim(F.col(name)).try_cast(RAW_DECIMAL) for name in numbers}
    values.update(
        fleet_id=key("fleet_id"),
        vehicle_id=key("vehicle_id"),
        recorded_at=instant_of(F.col("recorded_at")),
        weather=F.col("weather"),
        engine_on=_flag("engine_on"),
    )
    # Going through a generator pins these values: a filter on them further up cannot be moved
    # below, where every mention of a value would be replaced by its whole parsing expression.
    row = F.struct(*[column.alias(f"typed_{name}") for name, column in values.items()])
    return raw.select("*", F.inline(F.array(row)))


def _reasons(as_of: Column, uuid_keys: bool) -> Column:
    """Reason codes of one typed row, in a fixed order.

    The patterns are tried only on text that could not be typed, to tell the defects apart.
    """

    def unread(name: str) -> Column:
        return _value(name).isNull() & F.col(name).isNotNull()

    def no_number(name: str) -> Column:
        return unread(name) & ~F.col(name).rlike(_NUMBER)

    def out_of(name: str, low: int, high: int) -> Column:
        # A number too long for the wide decimal is out of range rather than unreadable.
        return ~_value(name).between(low, high) | (unread(name) & F.col(name).rlike(_NUMBER))

    checks = [(f"missing_{name}", F.col(name).isNull()) for name in REQUIRED_FIELDS]
    if uuid_keys:
        checks += [("fleet_uuid", unread("fleet_id")), ("vehicle_uuid", unread("vehicle_id"))]
    for name, bounds in RANGES.items():
        rounded = F.round(_value(name), DECIMALS[name])
        checks += [
            (f"{_code(name)}_type", no_number(name)),
            (f"{_code(name)}_range", out_of(name, *bounds)),
            (f"{_code(name)}_scale", _value(name) != rounded),
        ]
    battery = _value("battery_level")
    fraction = battery != F.round(battery, 0)
    checks += [
        ("battery_type", no_number("battery_level") | fraction),
        ("battery_range", out_of("battery_level", *BATTERY_RANGE) & ~F.coalesce(fraction, F.lit(False))),
        ("zero_position", (_value("latitude") == 0) & (_value("longitude") == 0)),
    ]
    sent = F.trim(F.col("recorded_at"))
    naive = sent.try_cast("timestamp").isNotNull() & ~sent.rlike(ZONED)
    acceleration = _value("acceleration")
    too_large = acceleration.isNotNull() & acceleration.try_cast(ACCELERATION).isNull()
    checks += [
        ("time_naive", unread("recorded_at") & naive),
        ("time_type", unread("recorded_at") & ~naive),
        ("time_future", _value("recorded_at") > as_of + F.expr(f"INTERVAL {FUTURE_SECONDS} SECONDS")),
        ("acceleration_type", no_number("acceleration")),
        ("acceleration_range", too_large | (unread("acceleration") & ~no_number("acceleration"))),
        ("weather_length", F.length("weather") > WEATHER_LENGTH),
        ("engine_type", unread("engine_on")),
    ]
    return _codes(checks)


def _codes(checks: list[tuple[str, Column]]) -> Column:
    marks = [F.when(failed, F.lit(code)).otherwise(F.lit("")) for code, failed in checks]
    return F.array_remove(F.array(*marks), "")


def check(
    raw: DataFrame,
    as_of: datetime | Column | None = None,
    uuid_keys: bool = True,
    corrupt_column: str = "_corrupt_record",
) -> DataFrame:
    """Raw rows plus typed columns and ``reasons``; an empty reason list means accepted.

    ``as_of`` is the clock of the future check: an instant or a column such as the arrival time.
    An unreadable JSON line gets the single reason ``malformed_json``.
    """
    clock = as_of if isinstance(as_of, Column) else F.lit(utc(as_of))
    found = _reasons(clock, uuid_keys)
    if corrupt_column in raw.columns:
        broken = F.col(corrupt_column).isNotNull()
        found = F.when(broken, F.array(F.lit("malformed_json"))).otherwise(found)
    # Pinned likewise, so that the reasons are worked out once per row.
    return typed(raw, uuid_keys).select("*", F.explode(F.array(found)).alias("reasons"))


def _stored_columns(rules: Sequence[Rule]) -> list[Column]:
    """Typed fields as they are stored, and the labels.

    Labels come from the values as received; only then are those rounded to their stored scale.
    """
    return [
        F.col("fleet_id"),
        F.col("vehicle_id"),
        F.col("speed").try_cast(SPEED).alias("speed"),
        F.col("latitude").try_cast(DEGREES).alias("latitude"),
        F.col("longitude").try_cast(DEGREES).alias("longitude"),
        F.col("battery_level").try_cast("smallint").alias("battery_level"),
        F.round("acceleration", ACCELERATION.scale).try_cast(ACCELERATION).alias("acceleration"),
        F.col("recorded_at"),
        F.col("weather"),
        F.col("engine_on"),
        detect(rules).alias("scenarios"),
    ]


def accepted(
    checked: DataFrame, keep: tuple[str, ...] = (), rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Rows without defects as typed, tagged events; ``keep`` names columns to carry along."""
    values = [_value(name).alias(name) for name in REQUIRED_FIELDS + OPTIONAL_FIELDS]
    rows = checked.filter(F.size("reasons") == 0).select(*keep, *values)
    return rows.select(*keep, *_stored_columns(rules))


def settled(checked: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Checked rows in the form to store: ``event`` of accepted rows, ``raw`` text of the others.

    Half the size of text and values side by side, and both parts can be read on their own.
    """
    fields = REQUIRED_FIELDS + OPTIONAL_FIELDS
    others = [
        name
        for name in checked.columns
        if name not in (*fields, "reasons") and not name.startswith("typed_")
    ]
    fine = F.size("reasons") == 0
    named = checked.select(
        *others,
        "reasons",
        F.when(~fine, F.struct(*fields)).alias("raw"),
        *[_value(name).alias(name) for name in fields],
    )
    event = F.when(fine, F.struct(*_stored_columns(rules)))
    return named.select(*others, "reasons", "raw", event.alias("event"))


def quarantined(checked: DataFrame) -> DataFrame:
    """Rows with defects as received, with their reasons."""
    typed_columns = [name for name in checked.columns if name.startswith("typed_")]
    return checked.filter(F.size("reasons") > 0).drop(*typed_columns)


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return accepted(checked), quarantined(checked)


def reason_counts(checked: DataFrame) -> DataFrame:
    """Rows per reason code; a row with two defects counts under both."""
    return (
        checked.select(F.explode("reasons").alias("reason"))
        .groupBy("reason")
        .agg(F.count("*").alias("row_count"))
    )


def stored_range_reasons(events: DataFrame, as_of: datetime | None = None) -> Column:
    """The same range, position and clock checks for rows that are already typed."""
    limit = F.lit(utc(as_of) + timedelta(seconds=FUTURE_SECONDS))
    checks = [
        (f"{_code(name)}_range", ~F.col(name).between(low, high))
        for name, (low, high) in RANGES.items()
    ]
    checks.append(("battery_range", ~F.col("battery_level").between(*BATTERY_RANGE)))
    checks.append(("zero_position", (F.col("latitude") == 0) & (F.col("longitude") == 0)))
    checks.append(("time_future", F.col("recorded_at") > limit))
    checks.append(("weather_length", F.length("weather") > WEATHER_LENGTH))
    return _codes(checks)
