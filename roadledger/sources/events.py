"""Reading and appending vehicle events."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadledger import schemas
from roadledger.functions.expressions import instant_of, json_ready, month_of
from roadledger.schemas import EVENT_PARTITIONS, LABELS, require_columns
from roadledger.session import path_exists, use_utc
from roadledger.sources.layers import Conflict, Names, Version, VersionLog, delete

CORRUPT = "_corrupt_record"
RECEIVED = "received_at"
# Batches of this name are parts that compaction has written.
PART = "part~"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The stored event table with its partition columns."""
    events = _stored(spark, path)
    if "ingest_batch" in events.columns:
        events = events.filter(_live(VersionLog(path).newest(spark)))
    return require_columns(events, schemas.core_events().names)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows in the table's folders, batch names as they are written there."""
    events = use_utc(spark).read.parquet(path)
    if "ingest_batch" in events.columns and events.schema["ingest_batch"].dataType != T.StringType():
        # Folder names that are all numbers are taken for numbers, which loses leading zeros.
        columns = [T.StructField(f.name, T.StringType()) if f.name == "ingest_batch" else f for f in events.schema]
        events = spark.read.schema(T.StructType(columns)).parquet(path)
    return events


def stream_events(spark: SparkSession, path: str, key: T.DataType = T.StringType(), **options):
    """The stored event table as a stream of appended files.

    What compaction writes is no news. A stream that starts anew sees the batches that
    :func:`clean_events` has left; what is older is in :func:`read_events`.
    """
    reader = use_utc(spark).readStream.schema(schemas.stored_events(key))
    appended = reader.options(**options).parquet(path)
    return appended.filter(~F.startswith("ingest_batch", F.lit(PART)))


def _landing_schema() -> T.StructType:
    return schemas.raw_event().add(RECEIVED, T.StringType(), True).add(CORRUPT, T.StringType(), True)


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one event each, every field as text; unreadable lines in ``_corrupt_record``.

    The file position is the arrival order. A row arrived when its collector stamped it
    (``received_at``), or else at the time of its file; a stamp cannot be later than the file.
    """
    reader = use_utc(spark).read.schema(_landing_schema())
    return _with_arrival(reader.option("columnNameOfCorruptRecord", CORRUPT).json(path))


def stream_landing(spark: SparkSession, path: str, **options) -> DataFrame:
    """The same landing folder as a stream; ``maxFilesPerTrigger`` and the like pass through."""
    reader = use_utc(spark).readStream.schema(_landing_schema()).options(**options)
    return _with_arrival(reader.option("columnNameOfCorruptRecord", CORRUPT).json(path))


def _with_arrival(raw: DataFrame) -> DataFrame:
    stored = F.col("_metadata.file_modification_time")
    return raw.withColumn("arrived_at", F.least(instant_of(F.col(RECEIVED)), stored)).drop(RECEIVED)


def parse_messages(messages: DataFrame, value: str = "value", arrived: str = "timestamp"):
    """Landing rows from a message source such as Kafka (``value`` bytes or text, ``timestamp``)."""
    text = F.col(value).cast("string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json(text, _landing_schema(), options)
    stamped = F.least(instant_of(F.col(f"_row.{RECEIVED}")), F.col(arrived)).alias("arrived_at")
    rows = messages.select(parsed.alias("_row"), F.col(arrived)).select("_row.*", stamped)
    return rows.drop(RECEIVED)


def with_defaults(events: DataFrame, ingested_at: datetime | None = None) -> DataFrame:
    """Fill what an append may leave out: a fresh id, the ingest time and an empty label array."""
    stamp = F.lit(ingested_at) if ingested_at is not None else F.current_timestamp()
    labels = F.array().cast(LABELS)

    def filled(name, default):
        return F.coalesce(name, default) if name in events.columns else default

    defaults = {
        "ingested_at": filled("ingested_at", stamp),
        "scenarios": filled("scenarios", labels),
    }
    if "id" not in events.columns:
        defaults["id"] = F.uuid()
    return events.withColumns(defaults)


def untagged(events: DataFrame) -> DataFrame:
    """The events with an empty label array, whatever they carry."""
    return events.withColumn("scenarios", F.array().cast(LABELS))


def with_partitions(events: DataFrame) -> DataFrame:
    """Add the month and date the event table is partitioned by."""
    return events.withColumns(
        {"event_month": month_of("recorded_at"), "event_date": F.to_date("recorded_at")}
    )


def append_events(
    events: DataFrame, path: str, batch: str, rows_per_file: int = 20_000_000
) -> None:
    """Append events under month, date and batch.

    Writing the same batch again replaces exactly its own directories, so a retried job neither
    loses nor doubles rows; a batch that compaction has taken up stays as it is there. The rebalance
    hint lets adaptive execution cut large dates into several even tasks and merge small ones; the
    sort makes row-group and page statistics selective for fleet and time filters.
    """
    if str(batch).startswith(PART):
        raise ValueError(f"batch names must not start with {PART}")
    if str(batch) in Names(VersionLog(path).newest(events.sparkSession).folded):
        return
    ready = with_partitions(with_defaults(events)).withColumn("ingest_batch", F.lit(str(batch)))
    columns = [*schemas.events().names, *EVENT_PARTITIONS, "ingest_batch"]
    _write_events(ready.select(*columns), path, rows_per_file)


def _write_events(ready: DataFrame, path: str, rows_per_file: int) -> None:
    (
        ready.hint("rebalance", F.col("event_date"))
        .sortWithinPartitions(*EVENT_PARTITIONS, "fleet_id", "recorded_at")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*EVENT_PARTITIONS, "ingest_batch")
        .parquet(path)
    )


def _live(version: Version) -> Column:
    """Parts that the newest version names, and batches that are not in one yet."""
    part, batch = F.startswith("ingest_batch", F.lit(PART)), F.col("ingest_batch")
    named = F.concat_ws("/", F.col("event_date").cast("string"), batch).isin(version.base) if version.base else F.lit(False)
    return F.when(part, named).otherwise(~batch.isin(version.changes) if version.changes else F.lit(True))


def _batches(spark: SparkSession, path: str) -> dict[str, list[tuple[str, str]]]:
    """Names of the batches and parts in the table, with the dates they lie in and their folders."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(f"{path}/event_month=*/event_date=*/ingest_batch=*")
    found: dict[str, list[tuple[str, str]]] = {}
    for status in pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []:
        folder = status.getPath().toString()
        day, batch = (unquote(part.partition("=")[2]) for part in folder.split("/")[-2:])
        found.setdefault(batch, []).append((day, folder))
    return found


def compact_events(
    spark: SparkSession, path: str, at_least: int = 2, parts_per_date: int = 8, rows_per_file: int = 20_000_000
) -> bool:
    """Fold the batches into one part per date, if there are ``at_least`` so many.

    A date that already has ``parts_per_date`` parts is written as one; other dates only get a part
    more, so a late event does not rewrite its date. The batches' names go into the version log,
    by which readers leave out their folders and a batch that is written again is known. Batches
    that arrive meanwhile stay as they are.
    """
    log = VersionLog(path)
    start = log.newest(spark)
    found = _batches(spark, path)
    batches = sorted(name for name in found if not name.startswith(PART) and name not in start.changes)
    if len(batches) < at_least:
        return False
    parts: dict[str, list[str]] = {}
    for entry in start.base:
        parts.setdefault(entry.partition("/")[0], []).append(entry)
    touched = {day for name in batches for day, _ in found[name]}
    merged = sorted(entry for day in touched if len(parts.get(day, ())) >= parts_per_date for entry in parts[day])
    part = f"{PART}{start.number}-{uuid.uuid4().hex[:8]}"
    stored = _stored(spark, path)
    taken = F.col("ingest_batch").isin(batches)
    if merged:
        taken |= F.concat_ws("/", F.col("event_date").cast("string"), "ingest_batch").isin(merged)
    _write_events(stored.filter(taken).withColumn("ingest_batch", F.lit(part)), path, rows_per_file)

    def folded(now: Version) -> Version:
        if set(batches) & set(now.changes) or not set(merged) <= set(now.base):
            raise Conflict(path)
        names = Names(now.folded)
        for name in batches:
            names.add(name)
        base = [entry for entry in now.base if entry not in set(merged)] + [f"{day}/{part}" for day in sorted(touched)]
        return replace(now, base=base, changes=now.changes + batches, folded=names.ranges)

    log.commit(spark, folded)
    return True


def clean_events(spark: SparkSession, path: str) -> None:
    """Delete the folders of folded batches and of parts that the newest version does not name.

    Not while an older version is still read or a compaction is running.
    """
    log = VersionLog(path)
    version, found = log.newest(spark), _batches(spark, path)
    live, gone = set(version.base), set(version.changes)
    for name, places in found.items():
        for day, folder in places:
            if name in gone or (name.startswith(PART) and f"{day}/{name}" not in live):
                delete(spark, folder)
    if gone:
        log.commit(spark, lambda now: replace(now, changes=[name for name in now.changes if name not in gone]))


def write_json(df: DataFrame, path: str) -> None:
    """Export results as JSON lines: decimals as numbers, times as ISO-8601 text."""
    json_ready(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_dimension(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Fleets, vehicles, alerts or the rollup, under their fixed schema.

    A table nobody has written yet reads as empty.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return use_utc(spark).read.schema(schema).parquet(path)
