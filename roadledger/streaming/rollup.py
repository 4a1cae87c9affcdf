"""Streams that keep the hourly rollup current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from roadledger import schemas
from roadledger.functions.expressions import hour_of, mean_of
from roadledger.operators.hourly import BUCKET, MEASURES, as_rollup
from roadledger.operators.rollup import affected_buckets, recompute
from roadledger.session import query_label, use_utc, written
from roadledger.sources.events import read_events
from roadledger.sources.tables import upsert_rollup


def refresh_rollup(new_events: DataFrame, events_path: str, rollup_path: str, writer: str, number: int = 0) -> None:
    """Recompute the buckets that new events fall into and put them in the rollup."""
    spark = new_events.sparkSession
    buckets = affected_buckets(new_events)
    if buckets.isEmpty():
        return
    upsert_rollup(recompute(read_events(spark, events_path), buckets), rollup_path, writer, number)


def start_rollup(
    appended: DataFrame,
    events_path: str,
    rollup_path: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Follow the event table and refresh the rollup, however late the events are.

    A query of its own: ingest goes on when this one fails, and this one catches up when it is
    started again. Changes carry the query's name and the batch number, so a repeated batch is
    not put in twice.
    """

    def run(new_events: DataFrame, batch_id: int) -> None:
        label = query_label(new_events.sparkSession, checkpoint)
        refresh_rollup(new_events, events_path, rollup_path, label, batch_id)

    return (
        appended.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def windowed_rollup(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Hourly rollup as a windowed stream aggregation (use output mode ``update``).

    Cheaper than recomputing buckets, as sums stay in the state store, but events later than
    ``lateness`` behind the newest one are dropped.
    """
    return (
        events.withWatermark("recorded_at", lateness)
        .groupBy("fleet_id", "vehicle_id", F.window("recorded_at", "1 hour").alias("window"))
        .agg(
            mean_of("speed").alias("avg_speed"),
            F.max("speed").alias("max_speed"),
            F.min("battery_level").cast("smallint").alias("min_battery"),
            F.count("*").cast("int").alias("event_count"),
        )
        .select(
            "fleet_id",
            "vehicle_id",
            F.col("window.start").alias("hour_bucket"),
            "avg_speed",
            "max_speed",
            "min_battery",
            "event_count",
        )
    )


def start_windowed_rollup(
    appended: DataFrame,
    events_path: str,
    rollup_path: str,
    checkpoint: str,
    lateness: str = "1 hour",
    trigger: dict | None = None,
) -> StreamingQuery:
    """The windowed rollup as one query that also serves the rows its watermark drops.

    The stream is read into two branches: window sums, and the bare buckets of all rows. Lateness is
    decided per window, so a bucket of the batch that is not among the updated windows has been
    dropped as late. Such buckets are recomputed from the event table, as in :func:`start_rollup`,
    and both results are one change of the rollup. A window that was dropped once never opens
    again, so a correction is not overwritten by older sums. The late buckets of each batch are
    kept (:func:`read_late`).
    """
    sums = windowed_rollup(appended, lateness)
    rows = sums.select(*BUCKET, F.struct(*MEASURES).alias("measures"))
    none = F.lit(None).cast(rows.schema["measures"].dataType)
    buckets = appended.select(*BUCKET[:2], hour_of().alias(BUCKET[2]), none.alias("measures"))

    def run(both: DataFrame, batch_id: int) -> None:
        spark = both.sparkSession
        label = query_label(spark, checkpoint)
        here = f"{checkpoint}-late/{label}/batch={batch_id}"
        # Buckets are folded before they are written: a row per bucket, whatever the events.
        seen = both.groupBy(*BUCKET).agg(F.first("measures", ignorenulls=True).alias("measures"))
        seen = written(seen, f"{here}/seen")
        late = written(seen.filter("measures IS NULL").select(*BUCKET), f"{here}/late")
        fresh = as_rollup(seen.filter("measures IS NOT NULL").select(*BUCKET, "measures.*"))
        if not late.isEmpty():
            fresh = fresh.unionByName(recompute(read_events(spark, events_path), late))
        upsert_rollup(fresh, rollup_path, label, batch_id)

    return (
        rows.unionByName(buckets)
        .writeStream.outputMode("update")
        .foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_late(spark: SparkSession, checkpoint: str, key: T.DataType = T.StringType()) -> DataFrame:
    """The buckets that were recomputed because of late rows, by batch of the query."""
    schema = T.StructType([*(f for f in schemas.hourly(key).fields if f.name in BUCKET), T.StructField("batch", T.LongType())])
    label = query_label(spark, checkpoint)
    return use_utc(spark).read.schema(schema).option("basePath", f"{checkpoint}-late/{label}").parquet(f"{checkpoint}-late/{label}/batch=*/late")
