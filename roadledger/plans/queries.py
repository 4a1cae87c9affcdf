"""The registered queries: every operator over the whole test tables.

Results are plain: decimals as doubles, integers as bigint, times without zone, label arrays as
comma-joined text, so that they can be compared with the checking SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadledger import schemas
from roadledger.functions import expressions as X
from roadledger.operators import (
    admission,
    alerts,
    filters,
    fleet,
    hourly,
    labels,
    latest,
    paging,
    quality,
    reports,
    validate,
)
from roadledger.session import shared_dir, use_utc, written
from roadledger.sources import events as event_source
from roadledger.sources import fixtures as fx
from roadledger.sources import tables, upgrade
from roadledger.streaming import admission as stream_admission
from roadledger.streaming import alerts as alert_scan
from roadledger.streaming import ingest as stream_ingest_job
from roadledger.streaming import latest as stream_latest_job
from roadledger.streaming import rollup as stream_rollup_job

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEY = T.LongType()
AS_OF = fx.AS_OF
WEEK = fx.LOOKBACK_MINUTES
# A small bucket, as the test data is sparse; its rate is exact in binary.
NO_EXPIRY = 10**9
BUCKET = admission.TokenBucket(3, 1, 2048, NO_EXPIRY)
EXPIRING = admission.TokenBucket(3, 1, 2048, 3600)
ROLLUP_COLUMNS = (*hourly.BUCKET, *hourly.MEASURES)


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(function(use_utc(spark), sf_dir))

    run.__doc__ = function.__doc__
    QUERIES[function.__name__] = run
    return run


def plain(df: DataFrame) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(field.name), field.dataType
        if isinstance(kind, T.DecimalType):
            column = column.cast("double")
        elif isinstance(kind, T.IntegralType):
            column = column.cast("bigint")
        elif isinstance(kind, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(kind, T.DateType):
            column = column.cast("string")
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column, ",")
        columns.append(column.alias(field.name))
    return df.select(*columns)


# Labels


@query
def detect_scenarios(spark, sf_dir):
    return fx.vehicle_events(spark, sf_dir).select("id", "fleet_id", "scenarios")


@query
def scenario_counts(spark, sf_dir):
    return labels.label_counts(fx.vehicle_events(spark, sf_dir))


@query
def scenario_counts_in_range(spark, sf_dir):
    start = datetime(2024, 1, 10, tzinfo=timezone.utc)
    end = datetime(2024, 1, 20, 12, tzinfo=timezone.utc)
    return labels.label_counts(fx.partitioned_events(spark, sf_dir), start=start, end=end)


@query
def scenario_share(spark, sf_dir):
    return labels.label_shares(labels.label_counts(fx.vehicle_events(spark, sf_dir)))


@query
def label_descriptions(spark, sf_dir):
    return labels.described_counts(labels.label_counts(fx.vehicle_events(spark, sf_dir)))


@query
def scenario_events_page(spark, sf_dir):
    """Rows 6 to 25 of every fleet's hard brakes, newest first."""
    return paging.label_page(fx.vehicle_events(spark, sf_dir), "hard_brake", limit=20, offset=5)


@query
def scenario_page_deep(spark, sf_dir):
    """Rows 13 to 1200 of every fleet's low batteries, by the rank index of deep pages."""
    events = fx.partitioned_events(spark, sf_dir)
    return paging.label_page(events, "low_battery", limit=1188, offset=12, rows_per_slice=2)


@query
def one_fleet_page(spark, sf_dir):
    """Rows 11 to 1010 of one fleet's low batteries."""
    return paging.label_page(fx.vehicle_events(spark, sf_dir), "low_battery", 2, limit=1000, offset=10)


@query
def scenario_page_envelope(spark, sf_dir):
    """Label, total, paging arguments and the page of every fleet."""
    pages = paging.page_envelope(fx.vehicle_events(spark, sf_dir), "hard_brake", limit=30, offset=4)
    ids = F.col("results.event_id").cast("array<string>")
    return pages.withColumn("results", F.array_join(ids, ","))


@query
def tagged_events(spark, sf_dir):
    """Events with at least one label."""
    return filters.tagged(fx.vehicle_events(spark, sf_dir)).select("id", "fleet_id", "scenarios")


@query
def one_hour(spark, sf_dir):
    """Events of one UTC hour."""
    hour = datetime(2024, 1, 15, 7, 30, tzinfo=timezone.utc)
    events = filters.hour_slice(fx.partitioned_events(spark, sf_dir), hour)
    return events.select("id", "fleet_id", "vehicle_id", "recorded_at")


@query
def one_vehicle_hours(spark, sf_dir):
    """Hourly statistics of one vehicle of one fleet."""
    return hourly.hourly_stats(fx.vehicle_events(spark, sf_dir), 2, 7, hours=None)


@query
def scenario_events_total(spark, sf_dir):
    return paging.label_total(fx.vehicle_events(spark, sf_dir), "hard_brake")


@query
def containment(spark, sf_dir):
    """Events carrying both labels."""
    wanted = filters.has_all_labels(["risky_weather_event", "over_speeding"])
    events = fx.vehicle_events(spark, sf_dir).filter(wanted)
    return events.select("id", "fleet_id", "recorded_at", "scenarios")


# Vehicles and fleets


@query
def hourly_vehicle_stats(spark, sf_dir):
    return hourly.hourly_stats(fx.untagged_events(spark, sf_dir), hours=None)


@query
def hourly_vehicle_stats_lookback(spark, sf_dir):
    """The last seven days before a moment inside an hour, so the oldest bucket is partial."""
    as_of = AS_OF - timedelta(minutes=30)
    return hourly.hourly_stats(fx.untagged_events(spark, sf_dir), hours=168, as_of=as_of)


@query
def hourly_chart(spark, sf_dir):
    stats = hourly.hourly_stats(fx.untagged_events(spark, sf_dir), hours=None)
    return hourly.chart_series(stats)


@query
def hourly_rollup(spark, sf_dir):
    return hourly.rollup_rows(fx.untagged_events(spark, sf_dir), AS_OF).select(*ROLLUP_COLUMNS)


@query
def rollup_scan(spark, sf_dir):
    rollup = hourly.rollup_rows(fx.untagged_events(spark, sf_dir), AS_OF)
    return hourly.read_rollup(rollup, since=AS_OF - timedelta(days=10))


@query
def fleet_summary(spark, sf_dir):
    return fleet.fleet_summary(fx.untagged_events(spark, sf_dir), as_of=AS_OF)


@query
def fleet_summary_from_rollup(spark, sf_dir):
    """The summary from a stored rollup and the last hour of the event table."""
    root, events = shared_dir(spark, "summary"), fx.vehicle_events(spark, sf_dir)
    event_source.append_events(events, f"{root}/events", "load")
    stored = event_source.read_events(spark, f"{root}/events")
    tables.upsert_rollup(hourly.rollup_rows(stored, AS_OF), f"{root}/hourly", "load")
    rollup = tables.read_rollup_table(spark, f"{root}/hourly", KEY)
    return fleet.summary_from_rollup(rollup, stored, as_of=AS_OF)


@query
def vehicle_count(spark, sf_dir):
    return fleet.vehicle_count(fx.untagged_events(spark, sf_dir))


@query
def battery_bands(spark, sf_dir):
    return fleet.battery_bands(fx.untagged_events(spark, sf_dir))


@query
def latest_event_per_vehicle(spark, sf_dir):
    return latest.latest_events(fx.untagged_events(spark, sf_dir))


@query
def low_battery_vehicles(spark, sf_dir):
    return latest.low_battery_vehicles(fx.untagged_events(spark, sf_dir))


@query
def overspeed_latest(spark, sf_dir):
    events = fx.untagged_events(spark, sf_dir)
    return latest.latest_overspeed(events, lookback_minutes=WEEK, as_of=AS_OF)


@query
def overspeed_new_alerts(spark, sf_dir):
    events, known = fx.untagged_events(spark, sf_dir), fx.alert_table(spark, sf_dir)
    return alerts.new_overspeed_alerts(events, known, lookback_minutes=WEEK, as_of=AS_OF)


@query
def critical_battery_alerts(spark, sf_dir):
    events, known = fx.untagged_events(spark, sf_dir), fx.alert_table(spark, sf_dir)
    found = alerts.new_critical_battery_alerts(
        events, known, lookback_minutes=WEEK, as_of=AS_OF
    )
    return found.select("fleet_id", "vehicle_id", "alert_type", "severity", "triggered_at")


@query
def alert_log(spark, sf_dir):
    """The log after two scans of the stored events; the second one finds nothing new."""
    root = shared_dir(spark, "alert-log")
    event_source.append_events(fx.vehicle_events(spark, sf_dir), f"{root}/events", "load")
    tables.append_rows(fx.alert_table(spark, sf_dir), f"{root}/alerts")
    for _ in range(2):
        alert_scan.scan_for_alerts(
            spark, f"{root}/events", f"{root}/alerts", None, WEEK, AS_OF, KEY
        )
    log = event_source.read_dimension(spark, f"{root}/alerts", schemas.alerts(KEY))
    return log.select("fleet_id", "vehicle_id", "alert_type", "acknowledged", "triggered_at")


# Ingest checks, storage and table quality


def _checked(spark, sf_dir):
    rows = fx.landing_rows(fx.untagged_events(spark, sf_dir))
    return validate.check(rows, AS_OF, uuid_keys=False)


def _valid(spark, sf_dir):
    rows = validate.accepted(_checked(spark, sf_dir), keep=("id", "arrived_at"))
    key = {name: F.col(name).cast(KEY) for name in ("fleet_id", "vehicle_id")}
    return rows.withColumns(key).withColumnRenamed("arrived_at", "ingested_at")


@query
def valid_events(spark, sf_dir):
    return _valid(spark, sf_dir)


@query
def quarantine_reasons(spark, sf_dir):
    return validate.reason_counts(_checked(spark, sf_dir))


@query
def quarantined_rows(spark, sf_dir):
    return validate.quarantined(_checked(spark, sf_dir)).select("id", "reasons")


def _landed(spark, sf_dir):
    path = fx.json_landing(spark, sf_dir, shared_dir(spark, "json-landing"))
    rows = event_source.read_landing(spark, path)
    return validate.check(rows, F.col("arrived_at"), uuid_keys=True)


@query
def json_landing(spark, sf_dir):
    """Accepted rows of JSON files; ``arrived_at`` is null where the file's time stood in for it."""
    fixed = F.col("arrived_at") < F.lit(datetime(2025, 1, 1, tzinfo=timezone.utc))
    valid = validate.accepted(_landed(spark, sf_dir), keep=("arrived_at",))
    return valid.withColumn("arrived_at", F.when(fixed, F.col("arrived_at"))).select(
        "fleet_id", "vehicle_id", "recorded_at", "arrived_at", "speed", "battery_level", "scenarios"
    )


@query
def json_landing_reasons(spark, sf_dir):
    return validate.reason_counts(_landed(spark, sf_dir))


@query
def stored_range_violations(spark, sf_dir):
    events = fx.untagged_events(spark, sf_dir)
    reasons = validate.stored_range_reasons(events, AS_OF)
    return events.select("id", reasons.alias("reasons")).filter(F.size("reasons") > 0)


@query
def event_store(spark, sf_dir):
    """Events per month and date of the partitioned table, a batch of it written twice."""
    path = shared_dir(spark, "event-store")
    events = fx.vehicle_events(spark, sf_dir)
    for batch in ("first", "first", "second"):
        event_source.append_events(events, path, batch)
    stored = event_source.read_events(spark, path)
    return stored.groupBy("event_month", "event_date").agg(F.count("*").alias("event_count"))


@query
def event_store_compacted(spark, sf_dir):
    """Events in twelve batches, folded twice and cleaned, a folded batch written again."""
    path = shared_dir(spark, "event-store")
    events = fx.vehicle_events(spark, sf_dir)
    for batch in range(12):
        event_source.append_events(events.filter(F.col("id") % 12 == batch), path, f"load-{batch}")
        if batch % 6 == 5:
            event_source.compact_events(spark, path, parts_per_date=1)
    event_source.append_events(events.filter("id % 12 = 2"), path, "load-2")
    event_source.clean_events(spark, path)
    stored = event_source.read_events(spark, path)
    return stored.groupBy("event_month", "event_date").agg(
        F.count("*").alias("event_count"), F.sum("id").alias("ids"), F.count_distinct("ingest_batch").alias("parts"),
        F.sum(F.size("scenarios")).alias("labels"), F.sum(F.unix_micros("recorded_at") % 1_000_003).alias("times"),
    )


@query
def month_coverage(spark, sf_dir):
    return quality.month_coverage(fx.partitioned_events(spark, sf_dir), AS_OF)


@query
def uniqueness_violations(spark, sf_dir):
    """Broken keys per table; the raw events keyed by vehicle hour have some."""
    events = fx.untagged_events(spark, sf_dir)
    checked = {
        "events": (events, quality.UNIQUE_KEYS["events"]),
        "vehicles": (fx.vehicle_table(spark, sf_dir), quality.UNIQUE_KEYS["vehicles"]),
        "fleets": (fx.fleet_table(spark, sf_dir), quality.UNIQUE_KEYS["fleets"]),
        "hourly": (hourly.rollup_rows(events, AS_OF), quality.UNIQUE_KEYS["hourly"]),
        "vehicle_hours": (
            events.withColumn("hour_bucket", X.hour_of()),
            quality.UNIQUE_KEYS["hourly"],
        ),
    }
    counted = None
    for name, (table, key) in checked.items():
        broken = quality.duplicates(table, key).agg(F.count("*").alias("violations"))
        row = broken.select(F.lit(name).alias("table_name"), "violations")
        counted = row if counted is None else counted.unionByName(row)
    return counted


@query
def repeated_vehicle_hours(spark, sf_dir):
    events = fx.untagged_events(spark, sf_dir).withColumn("hour_bucket", X.hour_of())
    return quality.duplicates(events, quality.UNIQUE_KEYS["hourly"])


@query
def orphan_vehicles(spark, sf_dir):
    found = quality.orphans(fx.vehicle_table(spark, sf_dir), fx.fleet_table(spark, sf_dir))
    return found.select("id", "fleet_id", "vin")


@query
def orphan_events(spark, sf_dir):
    events, fleets = fx.untagged_events(spark, sf_dir), fx.fleet_table(spark, sf_dir)
    return quality.orphan_counts(events, fleets)


@query
def cascade_delete(spark, sf_dir):
    fleets = fx.fleet_table(spark, sf_dir)
    left = quality.without_fleets(fx.vehicle_table(spark, sf_dir), fleets.filter("id < 2"))
    return left.select("id", "fleet_id", "vin")


@query
def insert_if_absent(spark, sf_dir):
    """Vehicles named by events, first mention wins, where fleets 0 to 2 are stored already."""
    mentions = fx.untagged_events(spark, sf_dir).select(
        "fleet_id",
        F.concat(F.lit("VIN-"), F.col("vehicle_id")).alias("vin"),
        F.col("id").alias("first_event"),
        "recorded_at",
    )
    stored = fx.vehicle_table(spark, sf_dir).filter("fleet_id < 3")
    return tables.only_new(mentions, stored, ("fleet_id", "vin"), ("recorded_at", "first_event"))


@query
def rollup_upsert(spark, sf_dir):
    """A stale rollup brought up to date, the upsert run twice."""
    root = shared_dir(spark, "rollup-upsert")
    tables.upsert_rollup(fx.old_rollup(spark, sf_dir), f"{root}/hourly", "load")
    fresh = hourly.rollup_rows(fx.untagged_events(spark, sf_dir), AS_OF)
    for run in (1, 2):
        tables.upsert_rollup(fresh, f"{root}/hourly", "job", run)
    stored = tables.read_rollup_table(spark, f"{root}/hourly", KEY)
    return stored.select(*ROLLUP_COLUMNS, "computed_at")


@query
def rollup_compacted(spark, sf_dir):
    """The same with upserts of single weeks in between, folded into the base twice."""
    path = f"{shared_dir(spark, 'rollup-compacted')}/hourly"
    tables.upsert_rollup(fx.old_rollup(spark, sf_dir), path, "load")
    fresh = written(hourly.rollup_rows(fx.untagged_events(spark, sf_dir), AS_OF), f"{path}-fresh")
    for number in range(6):
        part = fresh.filter(F.floor(F.dayofyear("bucket_date") / 7) == number)
        tables.upsert_rollup(part, path, "job", number, compact_after=3)
    tables.rollup_table(path).clean(spark)
    return tables.read_rollup_table(spark, path, KEY).select(*ROLLUP_COLUMNS, "computed_at")


@query
def schema_upgrade(spark, sf_dir):
    """Events of versions 1 and 2 under the current columns."""
    old = upgrade.upgrade(fx.version_one(spark, sf_dir)).withColumn("version", F.lit(1))
    newer = upgrade.upgrade(fx.version_two(spark, sf_dir)).withColumn("version", F.lit(2))
    columns = ("version", "id", "acceleration", "weather", "engine_on", "scenarios")
    return old.unionByName(newer).select(*columns)


@query
def schema_downgrade(spark, sf_dir):
    """Label arrays to JSON text and back."""
    stored = upgrade.fill_labels(fx.version_two(spark, sf_dir), as_json=True)
    return upgrade.labels_from_json(
        stored.withColumn("stored_text", F.col("scenarios"))
    ).select("id", "stored_text", "scenarios")


@query
def json_export(spark, sf_dir):
    stats = hourly.hourly_stats(fx.untagged_events(spark, sf_dir), hours=None)
    return X.to_json_rows(stats)


@query
def api_key_verification(spark, sf_dir):
    """Vehicles whose presented key belongs to a registered fleet."""
    presented = fx.vehicle_table(spark, sf_dir).select(
        F.col("id").alias("vehicle_id"),
        F.concat(F.lit("key-"), F.col("fleet_id")).alias("api_key"),
    )
    fleets = fx.fleet_table(spark, sf_dir).select("api_key_hash", F.col("name").alias("fleet"))
    digests = presented.withColumn("api_key_hash", X.key_digest("api_key"))
    return digests.join(fleets, "api_key_hash").select("vehicle_id", "fleet", "api_key_hash")


# Admission and reports


@query
def rate_limited(spark, sf_dir):
    events = fx.untagged_events(spark, sf_dir)
    granted = written(admission.grants(events, BUCKET), shared_dir(spark, "grants"))
    return admission.admit(events, granted, BUCKET).select("id", "fleet_id", "admitted")


@query
def rate_limited_with_expiry(spark, sf_dir):
    """A bucket idle for more than an hour is full again."""
    events = fx.untagged_events(spark, sf_dir)
    return admission.grants(events, EXPIRING).select(
        "fleet_id", "second", "requested", "granted", "level"
    )


@query
def rate_limited_carried(spark, sf_dir):
    """Two batches that overlap in time, buckets carried over, with blocks of three lengths."""
    events = fx.untagged_events(spark, sf_dir)
    first, second = (F.lit(datetime(2024, 1, day, tzinfo=timezone.utc)) for day in (15, 20))
    early = (F.col("ingested_at") < first) | ((F.col("ingested_at") < second) & (F.col("id") % 2 == 1))
    done = None
    for length in (3600, 86_400, 30 * 86_400):
        carried = None
        for batch, rows in enumerate((events.filter(early), events.filter(~early)), 1):
            granted = admission.grants(rows, EXPIRING, carried, block_seconds=length)
            granted = written(granted, shared_dir(spark, "grants"))
            carried = written(admission.carried_over(granted, carried), shared_dir(spark, "levels"))
            part = granted.select(
                F.lit(length).alias("block_seconds"), F.lit(batch).alias("batch"),
                "fleet_id", "second", "clock", "requested", "granted", "level",
            )
            done = part if done is None else done.unionByName(part)
    return done


@query
def ingest_outcomes(spark, sf_dir):
    """Landing rows per fleet and status: checked first, then admitted."""
    refused = validate.quarantined(_checked(spark, sf_dir))
    invalid = reports.invalid_counts(refused.withColumn("fleet_id", F.col("fleet_id").cast(KEY)))
    granted = admission.grants(_valid(spark, sf_dir), BUCKET)
    return reports.outcome_counts(admission.outcomes(granted).unionByName(invalid))


@query
def rejections(spark, sf_dir):
    granted = admission.grants(fx.untagged_events(spark, sf_dir), BUCKET)
    return reports.rejection_counts(admission.outcomes(granted))


@query
def lag_histogram(spark, sf_dir):
    events = fx.untagged_events(spark, sf_dir)
    bounds = reports.histogram(events, reports.ingest_lag(), reports.TASK_BOUNDS, ["fleet_id"])
    return bounds.select("fleet_id", F.col("upper_bound").cast("string"), "event_count")


@query
def latency_report(spark, sf_dir):
    report = reports.latency_report(fx.request_log(spark, sf_dir), ["endpoint"])
    rounded = ("error_rate", "throughput", "mean", "p50", "p95", "p99")
    return report.withColumns({name: F.round(name, 7) for name in rounded})


@query
def hit_ratio(spark, sf_dir):
    report = reports.hit_ratio(fx.request_log(spark, sf_dir))
    return report.withColumn("hit_ratio", F.round("hit_ratio", 9))


# Streams, each run until the present files are done


@query
def stream_ingest(spark, sf_dir):
    """Landing rows as a stream through checks, admission, tagging and append."""
    paths = stream_ingest_job.IngestPaths(shared_dir(spark, "ingest"))
    landing = fx.landing_rows(fx.as_events(fx.raw_stream(spark, sf_dir)))
    stream_ingest_job.start_ingest(landing, paths, BUCKET, uuid_keys=False).awaitTermination()
    stored = event_source.read_events(spark, paths.events)
    return stored.select(
        "id", F.col("fleet_id").cast(KEY), F.col("vehicle_id").cast(KEY), "recorded_at",
        "event_month", "speed", "scenarios",
    )


@query
def stream_refused(spark, sf_dir):
    """Valid landing rows that the ingest stream's limiter refused."""
    paths = stream_ingest_job.IngestPaths(shared_dir(spark, "ingest"))
    landing = fx.landing_rows(fx.as_events(fx.raw_stream(spark, sf_dir)))
    stream_ingest_job.start_ingest(landing, paths, BUCKET, uuid_keys=False).awaitTermination()
    refused = stream_ingest_job.read_refused(spark, paths)
    return refused.select(
        "id", F.col("fleet_id").cast(KEY), F.col("vehicle_id").cast(KEY), "recorded_at", "speed", "ingested_at"
    )


@query
def stream_outcomes(spark, sf_dir):
    paths = stream_ingest_job.IngestPaths(shared_dir(spark, "outcomes"))
    landing = fx.landing_rows(fx.as_events(fx.raw_stream(spark, sf_dir)))
    stream_ingest_job.start_ingest(landing, paths, BUCKET, uuid_keys=False).awaitTermination()
    counts = stream_ingest_job.read_outcomes(spark, paths)
    return counts.withColumn("fleet_id", F.col("fleet_id").cast(KEY))


@query
def stream_ingest_repeats(spark, sf_dir):
    """Outcomes where every fourth landing row is sent twice."""
    paths = stream_ingest_job.IngestPaths(shared_dir(spark, "repeats"))
    landing = fx.landing_rows(fx.as_events(fx.raw_stream(spark, sf_dir)))
    again = fx.landing_rows(fx.as_events(fx.raw_stream(spark, sf_dir))).filter("id % 4 = 0")
    stream_ingest_job.start_ingest(
        landing.unionByName(again), paths, BUCKET, uuid_keys=False, repeats_within="1 hour"
    ).awaitTermination()
    counts = stream_ingest_job.read_outcomes(spark, paths)
    return counts.withColumn("fleet_id", F.col("fleet_id").cast(KEY))


@query
def stream_rollup(spark, sf_dir):
    """The event table followed by the rollup stream."""
    root = shared_dir(spark, "stream-rollup")
    event_source.append_events(fx.vehicle_events(spark, sf_dir), f"{root}/events", "load")
    appended = event_source.stream_events(spark, f"{root}/events", KEY)
    stream_rollup_job.start_rollup(
        appended, f"{root}/events", f"{root}/hourly", f"{root}/checkpoint"
    ).awaitTermination()
    return tables.read_rollup_table(spark, f"{root}/hourly", KEY).select(*ROLLUP_COLUMNS)


@query
def stream_rollup_late(spark, sf_dir):
    """Windowed sums over three appends, every fifth event of the first half arriving last."""
    root = shared_dir(spark, "rollup-late")
    events, half = fx.vehicle_events(spark, sf_dir), F.lit(datetime(2024, 1, 16, tzinfo=timezone.utc))
    early, held = F.col("recorded_at") < half, F.col("id") % 5 == 0
    for batch, rows in enumerate((events.filter(early & ~held), events.filter(~early), events.filter(early & held))):
        event_source.append_events(rows, f"{root}/events", str(batch))
        appended = event_source.stream_events(spark, f"{root}/events", KEY)
        stream_rollup_job.start_windowed_rollup(
            appended, f"{root}/events", f"{root}/hourly", f"{root}/checkpoint"
        ).awaitTermination()
    late = stream_rollup_job.read_late(spark, f"{root}/checkpoint", KEY).select(*hourly.BUCKET).distinct()
    stored = tables.read_rollup_table(spark, f"{root}/hourly", KEY).select(*ROLLUP_COLUMNS)
    late = late.withColumn("corrected", F.lit(True))
    return stored.join(late, list(hourly.BUCKET), "left").withColumn("corrected", F.coalesce("corrected", F.lit(False)))


@query
def stream_windowed_rollup(spark, sf_dir):
    root = shared_dir(spark, "windowed-rollup")
    rollup = stream_rollup_job.windowed_rollup(fx.as_events(fx.raw_stream(spark, sf_dir)))
    return _collected(rollup, root).select(*ROLLUP_COLUMNS)


@query
def stream_latest(spark, sf_dir):
    root = shared_dir(spark, "stream-latest")
    events = fx.as_events(fx.raw_stream(spark, sf_dir))
    stream_latest_job.start_latest(
        events, f"{root}/latest", f"{root}/checkpoint"
    ).awaitTermination()
    return stream_latest_job.read_latest(spark, f"{root}/latest", KEY)


@query
def stream_latest_batches(spark, sf_dir):
    """The same over five appends that are not in order of time, folded after every second one."""
    root = shared_dir(spark, "latest-batches")
    events = fx.vehicle_events(spark, sf_dir)
    for batch in range(5):
        event_source.append_events(events.filter(F.col("id") % 5 == (3 * batch + 1) % 5), f"{root}/events", str(batch))
        appended = event_source.stream_events(spark, f"{root}/events", KEY)
        stream_latest_job.start_latest(appended, f"{root}/latest", f"{root}/checkpoint", compact_after=2).awaitTermination()
    return stream_latest_job.read_latest(spark, f"{root}/latest", KEY)


@query
def stream_rate_limit(spark, sf_dir):
    """Buckets kept in the state store of the stream."""
    before = {name: spark.conf.get(name) for name in stream_admission.STATE_STORE_CONF}
    root = shared_dir(spark, "stream-limit")
    events = fx.as_events(fx.raw_stream(spark, sf_dir))
    try:
        for name, value in stream_admission.STATE_STORE_CONF.items():
            spark.conf.set(name, value)
        granted = _collected(stream_admission.stream_grants(events, EXPIRING), root)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return granted.select("fleet_id", "second", "requested", "granted")


def _collected(stream: DataFrame, root: str) -> DataFrame:
    """All updates of a stream over the present files, which come as one batch."""

    def run(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    (
        stream.writeStream.outputMode("update")
        .foreachBatch(run)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return stream.sparkSession.read.parquet(f"{root}/out")
