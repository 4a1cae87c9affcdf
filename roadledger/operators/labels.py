"""Label counts and shares."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadledger.functions.expressions import label_text
from roadledger.functions.rules import description_table
from roadledger.operators.filters import between, for_keys


def label_counts(
    events: DataFrame,
    fleet_id: Any = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Events per fleet and label, most frequent first. Counted map-side, so the shuffle
    carries one row per task, fleet and label. Events without labels vanish in the explode."""
    found = between(for_keys(events, fleet_id), start, end)
    return (
        found.select("fleet_id", F.explode("scenarios").alias("scenario_label"))
        .groupBy("fleet_id", "scenario_label")
        .agg(F.count("*").alias("event_count"))
        .orderBy("fleet_id", F.desc("event_count"), "scenario_label")
    )


def label_shares(counts: DataFrame) -> DataFrame:
    """Share of each label among a fleet's tags, in percent with one decimal.

    The total counts tags, not events: an event with two labels counts twice. The window runs
    over the counted rows, at most one per fleet and label.
    """
    total = F.sum("event_count").over(Window.partitionBy("fleet_id"))
    percent = F.round(
        F.col("event_count").cast("decimal(20,0)") * 100 / F.col("total").cast("decimal(20,0)"), 1
    )
    return counts.withColumn("total", total).select(
        "fleet_id",
        "scenario_label",
        label_text("scenario_label").alias("label_text"),
        "event_count",
        "total",
        percent.cast("decimal(4,1)").alias("percent"),
    )


def label_map(counts: DataFrame) -> DataFrame:
    """One row per fleet with a label -> count map."""
    entries = F.collect_list(F.struct("scenario_label", "event_count"))
    return counts.groupBy("fleet_id").agg(F.map_from_entries(entries).alias("summary"))


def described_counts(counts: DataFrame) -> DataFrame:
    """Counts over all fleets next to each rule's description; labels without events count 0."""
    totals = counts.groupBy("scenario_label").agg(F.sum("event_count").alias("event_count"))
    return (
        description_table(counts.sparkSession)
        .join(totals, "scenario_label", "left")
        .select(
            "scenario_label",
            label_text("scenario_label").alias("label_text"),
            "description",
            F.coalesce("event_count", F.lit(0)).alias("event_count"),
        )
    )
