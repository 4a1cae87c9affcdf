"""Event label rules.

A rule is a label, a boolean SQL expression over event columns and a description. Tagging an
event is one array expression inside the scan's code-generated stage; no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadledger.schemas import LABELS, OPTIONAL_FIELDS, require_columns


@dataclass(frozen=True)
class Rule:
    label: str
    condition: str
    description: str = ""


# Labels, thresholds, weather words and descriptions, in evaluation order.
RULES: tuple[Rule, ...] = (
    Rule("hard_brake", "acceleration < -7", "Deceleration below -7 m/s²."),
    Rule("rapid_acceleration", "acceleration > 7", "Acceleration above +7 m/s²."),
    Rule("over_speeding", "speed > 100", "Speed exceeds 100 km/h."),
    Rule("low_battery", "battery_level < 15", "Battery level below 15%."),
    Rule(
        "risky_weather_event",
        "acceleration < -7 AND lower(weather) IN ('rain', 'snow', 'fog')",
        "Hard brake during rain, snow, or fog.",
    ),
)

RULE_COLUMNS = ("speed", "battery_level", *OPTIONAL_FIELDS)


def labels(rules: Sequence[Rule] = RULES) -> frozenset[str]:
    return frozenset(rule.label for rule in rules)


def descriptions(rules: Sequence[Rule] = RULES) -> dict[str, str]:
    return {rule.label: rule.description for rule in rules}


def description_table(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(scenario_label, description) rows to join to a report; its size is the rule count."""
    rows = [(rule.label, rule.description) for rule in rules]
    return spark.createDataFrame(rows, "scenario_label string, description string")


def check_label(label: str, rules: Sequence[Rule] = RULES) -> str:
    """Refuse an unknown label before any plan is built."""
    known = sorted(labels(rules))
    if label not in known:
        raise ValueError(f"unknown scenario {label!r}; valid values: {known}")
    return label


def detect(rules: Sequence[Rule] = RULES) -> Column:
    """Labels of the rules that hold, in rule order, each once; never null.

    A rule over a null field is false. Apply it to the values as received: rounding a raw
    acceleration of -7.0004 to its stored scale first would lose the label.
    """
    marks = [
        F.when(F.coalesce(F.expr(rule.condition), F.lit(False)), F.lit(rule.label)).otherwise("")
        for rule in rules
    ]
    if not marks:
        return F.array().cast(LABELS)
    # array_remove is compiled with the rest of the stage; a lambda filter would not be.
    found = F.array_remove(F.array(*marks), "")
    if len(labels(rules)) < len(rules):
        found = F.array_distinct(found)
    return found


def _usable(events: DataFrame, rule: Rule) -> bool:
    """False when the rule names a column the events lack or compares unfit types."""
    try:
        events.select(F.expr(rule.condition).cast("boolean")).schema
    except AnalysisException:
        return False
    return True


def tag(events: DataFrame, rules: Sequence[Rule] = RULES, column: str = "scenarios") -> DataFrame:
    """Add the label array. Missing optional fields count as null; a rule that cannot be
    evaluated on these events never fires."""
    require_columns(events, ("speed", "battery_level"))
    types = {"acceleration": "decimal(7,3)", "weather": "string", "engine_on": "boolean"}
    absent = [name for name in OPTIONAL_FIELDS if name not in events.columns]
    widened = events.withColumns({name: F.lit(None).cast(types[name]) for name in absent})
    usable = rules if rules is RULES else [rule for rule in rules if _usable(widened, rule)]
    return widened.withColumn(column, detect(usable)).drop(*absent)
