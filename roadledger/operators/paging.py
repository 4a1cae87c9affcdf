"""Pages of labelled events."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadledger.functions.arguments import utc, within
from roadledger.operators.filters import between, labelled
from roadledger.schemas import LABELS
from roadledger.session import shared_dir, written

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

# Deepest page for which Spark itself limits groups before the shuffle, by its default setting.
GROUP_LIMIT = 1000
# Widths of time slices in microseconds: an hour, a second, a single time.
SLICES = (3_600_000_000, 1_000_000, 1)
NEWEST_FIRST = ("recorded_at", "event_id")


def as_results(events: DataFrame) -> DataFrame:
    """The event columns a page shows; a null label array reads as empty."""
    return events.select(
        "fleet_id",
        F.col("id").alias("event_id"),
        "vehicle_id",
        "recorded_at",
        "speed",
        "battery_level",
        "acceleration",
        "weather",
        F.coalesce("scenarios", F.array().cast(LABELS)).alias("scenarios"),
    )


def label_total(events: DataFrame, label: str, fleet_id: Any = None, **bounds: Any) -> DataFrame:
    """Size of the unpaged result: per fleet, or one row for one fleet (0 without events)."""
    found = labelled(events, label, fleet_id, **bounds)
    if fleet_id is not None:
        return found.agg(F.count("*").alias("total")).select(
            F.lit(fleet_id).alias("fleet_id"), "total"
        )
    return found.groupBy("fleet_id").agg(F.count("*").alias("total"))


def label_page(
    events: DataFrame,
    label: str,
    fleet_id: Any = None,
    start: datetime | None = None,
    end: datetime | None = None,
    limit: int = 100,
    offset: int = 0,
    before: tuple[datetime, Any] | None = None,
    group_limit: int = GROUP_LIMIT,
    rows_per_slice: int = 1_000_000,
) -> DataFrame:
    """One page of labelled events, newest first; equal times are settled by the larger id.

    For one fleet this is a top-k sort. With ``fleet_id=None`` every fleet gets its own page: each
    task sends its newest ``offset + limit`` rows per fleet at most. Pages that end beyond
    ``group_limit`` are looked up in a rank index instead (:func:`deep_page`). Who has the last row
    of the page before can pass its ``(recorded_at, event_id)`` as ``before`` in place of an
    offset, which reads no skipped rows.
    """
    within("limit", limit, 1)
    within("offset", offset, 0)
    found = labelled(events, label, fleet_id, start, end)
    if before is not None:
        moment, last_id = F.lit(utc(before[0])), F.lit(before[1])
        found = found.filter(
            (F.col("recorded_at") <= moment)
            & ((F.col("recorded_at") < moment) | (F.col("id") < last_id))
        )
    order = [F.desc(name) for name in NEWEST_FIRST]
    if offset + limit > group_limit:
        page = as_results(deep_page(found, limit, offset, rows_per_slice))
        return page if fleet_id is None else page.orderBy(*order)
    found = as_results(found)
    if fleet_id is not None:
        return found.orderBy(*order).offset(offset).limit(limit)
    rank = F.row_number().over(Window.partitionBy("fleet_id").orderBy(*order))
    return (
        found.withColumn("_rank", rank)
        .filter(F.col("_rank") <= offset + limit)
        .filter(F.col("_rank") > offset)
        .drop("_rank")
    )


def deep_page(found: DataFrame, limit: int, offset: int, rows_per_slice: int = 1_000_000) -> DataFrame:
    """Rows ``offset + 1`` to ``offset + limit`` of each fleet, newest first, by a rank index.

    Rows are counted per fleet and time slice, and the counts summed from the newest slice on. Only
    slices that the page reaches into are read again and sorted, each by itself, from the rank it
    starts at. Where one of them holds more than ``rows_per_slice``, they are counted again in
    narrower slices; rows of one and the same time are one slice at last.
    """
    spark = found.sparkSession
    folder = shared_dir(spark, "rank-index")
    rows, base = found, None
    for width in SLICES:
        slice_of = F.floor(F.unix_micros("recorded_at") / width)
        counts = rows.groupBy("fleet_id", slice_of.alias("slice")).agg(F.count("*").alias("n"))
        if base is None:
            counts = counts.withColumn("base", F.lit(0).cast("bigint"))
        else:
            counts = counts.join(base, "fleet_id")
        newest_first = Window.partitionBy("fleet_id").orderBy(F.desc("slice"))
        index = counts.withColumn("skipped", F.col("base") + F.sum("n").over(newest_first) - F.col("n"))
        wanted = index.filter((F.col("skipped") < offset + limit) & (F.col("skipped") + F.col("n") > offset))
        wanted = written(wanted.select("fleet_id", "slice", "skipped", "n"), f"{folder}/{width}")
        first, last, most = wanted.agg(F.min("slice"), F.max("slice"), F.max("n")).first()
        if first is None:
            return found.limit(0)
        begin, end = (EPOCH + timedelta(microseconds=edge * width) for edge in (first, last + 1))
        rows = between(found, begin, end).withColumn("slice", slice_of).join(wanted.drop("n"), ["fleet_id", "slice"])
        if most <= rows_per_slice:
            break
        base = wanted.groupBy("fleet_id").agg(F.min("skipped").alias("base"))
        if width > SLICES[-1]:
            rows = rows.drop("slice", "skipped")
    rank = F.col("skipped") + F.row_number().over(
        Window.partitionBy("fleet_id", "slice").orderBy(F.desc("recorded_at"), F.desc("id"))
    )
    return (
        rows.withColumn("_rank", rank)
        .filter((F.col("_rank") > offset) & (F.col("_rank") <= offset + limit))
        .select(*found.columns)
    )


def page_envelope(
    events: DataFrame, label: str, fleet_id: Any = None, limit: int = 100, offset: int = 0, **bounds
) -> DataFrame:
    """One row per fleet: label, total, paging arguments and the page as an array of rows."""
    within("limit", limit, 1)
    shown = label_page(events, label, fleet_id, limit=limit, offset=offset, **bounds)
    newest_first = F.reverse(F.array_sort(F.collect_list(F.struct(
        *NEWEST_FIRST,
        *[name for name in shown.columns if name not in (*NEWEST_FIRST, "fleet_id")],
    ))))
    pages = shown.groupBy("fleet_id").agg(newest_first.alias("results"))
    empty = F.array().cast(pages.schema["results"].dataType)
    return (
        label_total(events, label, fleet_id, **bounds)
        .join(pages, "fleet_id", "left")
        .select(
            "fleet_id",
            F.lit(label).alias("scenario"),
            "total",
            F.lit(limit).alias("limit"),
            F.lit(offset).alias("offset"),
            F.coalesce("results", empty).alias("results"),
        )
    )
