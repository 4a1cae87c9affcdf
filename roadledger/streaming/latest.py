"""The newest event per vehicle, kept current by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from roadledger import schemas
from roadledger.operators.latest import VEHICLE
from roadledger.session import query_label
from roadledger.sources.layers import Layered

STATE_COLUMNS = ("id", "recorded_at", "speed", "latitude", "longitude", "battery_level")


def latest_state(events: DataFrame) -> DataFrame:
    """One state row per vehicle; in output mode ``update`` only changed vehicles come out."""
    newest = F.max_by(F.struct(*STATE_COLUMNS), F.struct("recorded_at", "id"))
    return events.groupBy(*VEHICLE).agg(newest.alias("newest")).select(*VEHICLE, "newest.*")


def state_table(path: str) -> Layered:
    return Layered(path, VEHICLE, newest_by=("recorded_at", "id"))


def start_latest(
    events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, compact_after: int = 16
) -> StreamingQuery:
    """Put the changed vehicles of each batch on top of the state; fold them in every few batches.

    A repeated batch is not put in twice. After a fresh start the newest event of a vehicle still
    counts, whichever query brought it.
    """
    state = latest_state(events)
    table, schema = state_table(path), state.schema

    def run(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        table.append(changed, query_label(spark, checkpoint), batch_id)
        table.compact(spark, schema, compact_after)

    return (
        state.writeStream.outputMode("update")
        .foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_latest(spark: SparkSession, path: str, key: T.DataType = T.StringType()) -> DataFrame:
    """The current state: one snapshot and the batches after it."""
    columns = T.StructType([schemas.core_events(key)[name] for name in (*VEHICLE, *STATE_COLUMNS)])
    return state_table(path).read(spark, columns).select(*VEHICLE, *STATE_COLUMNS[2:], "recorded_at")
