"""Ingest checks on raw text rows and JSON lines."""

import json
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from roadledger import schemas
from roadledger.operators import validate
from roadledger.sources import events as source

AS_OF = datetime(2025, 3, 15, 12, tzinfo=timezone.utc)
FLEET = "3f2b8c1e-0a4d-4e6f-9b7a-1c2d3e4f5a6b"
GOOD = {
    "fleet_id": FLEET,
    "vehicle_id": FLEET.replace("3f2b", "aaaa"),
    "speed": "63.25",
    "latitude": "48.137250",
    "longitude": "11.575500",
    "battery_level": "41",
    "recorded_at": "2025-03-15T10:00:00Z",
    "acceleration": None,
    "weather": None,
    "engine_on": None,
}

DEFECTS = [
    ({"speed": "999"}, ["speed_range"]),
    ({"speed": "-1"}, ["speed_range"]),
    ({"speed": "1" + "0" * 30}, ["speed_range"]),
    ({"speed": "10.123"}, ["speed_scale"]),
    ({"speed": "fast"}, ["speed_type"]),
    ({"speed": "NaN"}, ["speed_type"]),
    ({"speed": "Infinity"}, ["speed_type"]),
    ({"latitude": "90.000001"}, ["lat_range"]),
    ({"latitude": "35.1234567"}, ["lat_scale"]),
    ({"longitude": "-180.5"}, ["lon_range"]),
    ({"battery_level": "101"}, ["battery_range"]),
    ({"battery_level": "65.5"}, ["battery_type"]),
    ({"battery_level": "full"}, ["battery_type"]),
    ({"latitude": "0", "longitude": "0.0"}, ["zero_position"]),
    ({"recorded_at": "2025-03-15T10:00:00"}, ["time_naive"]),
    ({"recorded_at": "2025-03-15"}, ["time_naive"]),
    ({"recorded_at": "yesterday"}, ["time_type"]),
    ({"recorded_at": "2025-02-30T10:00:00Z"}, ["time_type"]),
    ({"recorded_at": "2025-03-15T10:00:00 Europe/London"}, ["time_naive"]),
    ({"recorded_at": "2025-03-15T25:00:00Z"}, ["time_type"]),
    ({"recorded_at": "2025-03-15T12:05:01Z"}, ["time_future"]),
    ({"fleet_id": "fleet-1"}, ["fleet_uuid"]),
    ({"vehicle_id": "1234"}, ["vehicle_uuid"]),
    ({"weather": "x" * 65}, ["weather_length"]),
    ({"acceleration": "hard"}, ["acceleration_type"]),
    ({"acceleration": "10000"}, ["acceleration_range"]),
    ({"engine_on": "maybe"}, ["engine_type"]),
    *[({name: None}, [f"missing_{name}"]) for name in schemas.REQUIRED_FIELDS],
    ({"speed": "501", "battery_level": "-1"}, ["speed_range", "battery_range"]),
]

VALID = [
    {},
    {"speed": "0", "battery_level": "0", "latitude": "-90", "longitude": "180"},
    {"speed": "500.00", "battery_level": "100", "latitude": "0", "longitude": "0.000001"},
    {"speed": "10.1200", "battery_level": "65.0"},
    {"speed": "1e2"},
    {"recorded_at": "2025-03-15T12:05:00Z"},
    {"recorded_at": "2025-03-15 10:00:00+0900"},
    {"recorded_at": "2025-03-15T04:00:00.123456-05:30"},
    {"recorded_at": "2025-03-15t10:00:00z"},
    {"recorded_at": "2025-03-15 10:00Z"},
    {"recorded_at": "2025-03-15T10:00+00:00"},
    {"recorded_at": "2025-03-15_10:00:00 -0100"},
    {"recorded_at": "2025-03-15T10:00:00.5+00:00"},
    {"fleet_id": FLEET.upper()},
    {"fleet_id": FLEET.replace("-", "")},
    {"fleet_id": "{" + FLEET + "}"},
    {"weather": "x" * 64, "engine_on": "true", "acceleration": "-7.0004"},
]


def _checked(spark, changes):
    rows = [(str(i), *{**GOOD, **change}.values()) for i, change in enumerate(changes)]
    raw = spark.createDataFrame(rows, "i string, " + ", ".join(f"{n} string" for n in GOOD))
    return validate.check(raw, AS_OF)


def test_every_defect_has_its_reason(spark):
    checked = _checked(spark, [change for change, _ in DEFECTS])
    assert validate.accepted(checked).count() == 0
    found = {int(r.i): r.reasons for r in validate.quarantined(checked).collect()}
    for i, (change, reasons) in enumerate(DEFECTS):
        assert found[i] == reasons, change


def test_valid_rows(spark):
    checked = _checked(spark, VALID)
    assert [r.asDict() for r in validate.quarantined(checked).collect()] == []
    rows = {int(r.i): r for r in validate.accepted(checked, keep=("i",)).collect()}
    assert len(rows) == len(VALID)
    assert rows[0].speed == Decimal("63.25") and rows[0].scenarios == []
    assert rows[4].speed == Decimal("100.00") and rows[4].scenarios == []
    assert rows[13].fleet_id == rows[14].fleet_id == rows[15].fleet_id == FLEET
    # Tagged on the value received, stored with three decimals.
    assert rows[16].scenarios == ["hard_brake"]
    assert rows[16].acceleration == Decimal("-7.000") and rows[16].engine_on is True
    utc_hours = {8: 10, 9: 10, 10: 10, 11: 11, 12: 10}
    assert {i: rows[i].recorded_at.hour for i in utc_hours} == utc_hours


def test_offsets_land_in_the_utc_hour(spark):
    checked = _checked(spark, [{"recorded_at": "2025-03-15T10:30:00+09:00"}])
    hour = validate.accepted(checked).select(
        F.date_trunc("hour", "recorded_at").cast("string").alias("h")
    )
    assert hour.first().h == "2025-03-15 01:00:00"


def test_accepted_matches_the_stored_types(spark):
    stored = {f.name: f.dataType for f in schemas.events().fields}
    for field in validate.accepted(_checked(spark, VALID)).schema.fields:
        assert field.dataType == stored[field.name], field.name


def test_json_landing_with_strings_numbers_and_broken_lines(spark, tmp_path):
    numbers = dict(GOOD, speed=63.25, latitude=48.13725, battery_level=41, engine_on=True)
    lines = [json.dumps(GOOD), json.dumps(numbers), '{"fleet_id": "x", ', json.dumps({})]
    (tmp_path / "a.json").write_text("\n".join(lines))
    checked = validate.check(
        source.read_landing(spark, str(tmp_path)), datetime.now(timezone.utc) + timedelta(days=1)
    )
    valid, refused = validate.split(checked)
    assert [r.speed for r in valid.collect()] == [Decimal("63.25")] * 2
    reasons = sorted(r.reasons for r in refused.collect())
    assert reasons == [["malformed_json"], [f"missing_{n}" for n in schemas.REQUIRED_FIELDS]]


def test_messages_from_a_queue(spark):
    rows = [(json.dumps(GOOD).encode(), AS_OF), (b"not json", AS_OF)]
    messages = spark.createDataFrame(rows, "value binary, timestamp timestamp")
    checked = validate.check(source.parse_messages(messages), F.col("arrived_at"))
    assert sorted(r.reasons for r in checked.collect()) == [[], ["malformed_json"]]


def test_missing_column_is_refused(spark):
    with pytest.raises(ValueError, match="speed"):
        validate.check(spark.createDataFrame([("a",)], "fleet_id string"), AS_OF)


def test_values_are_parsed_once(spark):
    """The filter on the reasons must stay above the parsing."""
    plan = validate.accepted(_checked(spark, VALID))._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    assert text.index("Filter") < text.index("Generate")


@pytest.mark.parametrize(
    "sent,micros",
    [
        ("1742032800", 1742032800 * 10**6), ("1742032800000", 1742032800 * 10**6), (" 1742032800.25 ", 1742032800250000),
        ("1742032800123.5", 1742032800123500), ("0", 0), ("-86400", -86400 * 10**6), ("20000000000", None),
        ("20000000001", 20000000001 * 1000), ("+5", 5 * 10**6), ("1e9", None), ("0x10", None), ("99999999999999999", None),
    ],
)
def test_epoch_times(spark, sent, micros):
    """Seconds or, beyond 2 * 10**10, milliseconds; what is no time or in the future is set aside."""
    rows = spark.createDataFrame([{**GOOD, "recorded_at": sent}], schemas.raw_event())
    row = validate.check(rows, AS_OF).select("reasons", F.unix_micros("typed_recorded_at").alias("t")).first()
    if sent == "20000000000":
        assert row.reasons == ["time_future"] and row.t == 2 * 10**16
    elif micros is None:
        assert row.reasons in (["time_type"], ["time_naive"]) and row.t is None
    else:
        assert row.reasons == [] and row.t == micros


def test_arrival_is_the_collectors_stamp_or_the_files_time(spark, tmp_path):
    stamps = ["2025-03-15T10:00:00Z", "1742032800", None, "soon", "2999-01-01T00:00:00Z"]
    lines = [json.dumps({**GOOD, "received_at": stamp}) for stamp in stamps] + ['{"fleet_id": "x']
    (tmp_path / "a.json").write_text("\n".join(lines))
    rows = source.read_landing(spark, str(tmp_path)).select("*", F.unix_seconds("arrived_at").alias("t")).collect()
    stored = int((tmp_path / "a.json").stat().st_mtime)
    assert [r.t for r in rows[:2]] == [1742032800] * 2 and all(abs(r.t - stored) <= 1 for r in rows[2:])
    assert rows[5]["_corrupt_record"] == lines[5] and "received_at" not in rows[0].asDict()
    messages = spark.createDataFrame([(lines[0], AS_OF), (lines[2], AS_OF)], "value string, timestamp timestamp")
    parsed = source.parse_messages(messages).select(F.unix_seconds("arrived_at").alias("t")).collect()
    assert [r.t for r in parsed] == [1742032800, int(AS_OF.timestamp())]
