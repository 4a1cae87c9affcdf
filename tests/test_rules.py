"""Label rules: boundaries, combinations, registry, safe evaluation."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from roadledger.functions import rules
from roadledger.sources import fixtures as fx

EVENT = "speed decimal(38,18), battery_level int, acceleration decimal(38,18), weather string"

CASES = [
    ("60", 80, "-2.0", None, []),
    ("60", 80, "-7.0", None, []),
    ("60", 80, "-7.1", None, ["hard_brake"]),
    ("60", 80, "-7.0004", None, ["hard_brake"]),
    ("60", 80, "7.0", None, []),
    ("60", 80, "7.5", None, ["rapid_acceleration"]),
    ("100", 80, None, None, []),
    ("101", 80, None, None, ["over_speeding"]),
    ("60", 15, None, None, []),
    ("60", 14, None, None, ["low_battery"]),
    *[
        ("60", 80, "-8.0", weather, ["hard_brake", "risky_weather_event"])
        for weather in ("rain", "snow", "fog", "Rain", "SNOW", "Fog")
    ],
    *[("60", 80, "-8.0", weather, ["hard_brake"]) for weather in ("clear", None, " rain")],
    ("60", 80, "-3.0", "rain", []),
    ("110", 80, "8.5", None, ["rapid_acceleration", "over_speeding"]),
    (
        "120", 10, "-8.0", "rain",
        ["hard_brake", "over_speeding", "low_battery", "risky_weather_event"],
    ),
]


def test_rule_cases(spark):
    rows = [
        (i, Decimal(speed), battery, acceleration and Decimal(acceleration), weather)
        for i, (speed, battery, acceleration, weather, _) in enumerate(CASES)
    ]
    tagged = rules.tag(spark.createDataFrame(rows, f"i int, {EVENT}"))
    found = {row.i: row.scenarios for row in tagged.collect()}
    for i, case in enumerate(CASES):
        assert found[i] == case[-1], case


def test_optional_fields_may_be_missing(spark):
    events = spark.createDataFrame([(60, 50), (150, 10)], "speed int, battery_level int")
    tagged = rules.tag(events)
    assert tagged.columns == ["speed", "battery_level", "scenarios"]
    assert [r.scenarios for r in tagged.collect()] == [[], ["over_speeding", "low_battery"]]


def test_required_fields_are_checked(spark):
    with pytest.raises(ValueError, match="battery_level"):
        rules.tag(spark.createDataFrame([(60,)], "speed int"))


def test_registry():
    assert rules.labels() == {
        "hard_brake", "rapid_acceleration", "over_speeding", "low_battery", "risky_weather_event",
    }
    described = rules.descriptions()
    assert set(described) == rules.labels()
    assert all(described.values())


def test_unknown_label_is_refused_with_the_known_ones():
    with pytest.raises(ValueError, match="hard_brake.*low_battery"):
        rules.check_label("no_such_label")


def test_own_rules_and_safe_evaluation(spark):
    events = spark.createDataFrame([(60, 50)], "speed int, battery_level int")
    own = [
        rules.Rule("missing", "no_such_field > 0"),
        rules.Rule("unfit", "speed > array(1)"),
        rules.Rule("null", "CAST(NULL AS INT) > 0"),
        rules.Rule("moving", "speed > 0"),
        rules.Rule("moving", "speed > 1"),
    ]
    assert rules.tag(events, own).first().scenarios == ["moving"]
    assert rules.tag(events, []).first().scenarios == []


def test_tagging_stays_in_compiled_code(spark, data_dir):
    plan = fx.vehicle_events(spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "lambda" not in plan


def test_description_table(spark):
    table = rules.description_table(spark)
    assert {r.scenario_label: r.description for r in table.collect()} == rules.descriptions()
    assert table.filter(F.col("description") == "").count() == 0
