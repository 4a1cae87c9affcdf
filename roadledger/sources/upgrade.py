"""Bringing event tables of older versions to the current columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadledger.schemas import ACCELERATION, LABELS, OPTIONAL_FIELDS

_ADDED = {"acceleration": ACCELERATION, "weather": "string", "engine_on": "boolean"}


def read_all_versions(spark: SparkSession, *paths: str) -> DataFrame:
    """Files of several versions read as one table; absent columns are null."""
    return add_enrichment(spark.read.option("mergeSchema", "true").parquet(*paths))


def add_enrichment(events: DataFrame) -> DataFrame:
    """Version 1 to 2: the three optional columns (null) and the label array (empty)."""
    added = {
        name: F.lit(None).cast(kind) for name, kind in _ADDED.items() if name not in events.columns
    }
    if "scenarios" not in events.columns:
        added["scenarios"] = F.array().cast(LABELS)
    return events.withColumns(added)


def fill_labels(events: DataFrame, as_json: bool = False) -> DataFrame:
    """Version 2 to 3: null label arrays become empty; optionally stored as JSON text."""
    filled = F.coalesce("scenarios", F.array().cast(LABELS))
    return events.withColumn("scenarios", F.to_json(filled) if as_json else filled)


def upgrade(events: DataFrame) -> DataFrame:
    """Any older version to the current one."""
    return fill_labels(add_enrichment(events))


def labels_from_json(events: DataFrame) -> DataFrame:
    """Version 3 JSON text back to an array of labels."""
    return events.withColumn("scenarios", F.from_json("scenarios", "array<string>"))


def drop_enrichment(events: DataFrame) -> DataFrame:
    """Version 2 back to 1."""
    return events.drop(*OPTIONAL_FIELDS, "scenarios")
