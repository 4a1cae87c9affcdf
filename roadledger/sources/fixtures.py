"""Vehicle tables derived from the generic ``events`` test table.

The mapping is fixed so that the Spark side and the checking SQL see the same rows.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadledger.functions.rules import tag
from roadledger.schemas import SPEED
from roadledger.session import use_utc
from roadledger.sources.events import with_partitions

AS_OF = datetime(2024, 1, 31, tzinfo=timezone.utc)
LOOKBACK_MINUTES = 10_080  # the data is sparse, so alerts look back seven days
KNOWN_FLEETS = 4  # fleets 0..3 are registered, fleet 4 is not
OLD_ROLLUP_END = datetime(2024, 1, 15, tzinfo=timezone.utc)

EVENT_COLUMNS = (
    "event_id AS id",
    "user_id % 5 AS fleet_id",
    "user_id AS vehicle_id",
    "CAST(value AS DECIMAL(6,2)) AS speed",
    """CASE WHEN event_id % 211 = 0 THEN CAST(0 AS DECIMAL(9,6))
       ELSE CAST(CAST(34000 + event_id % 2000 AS DOUBLE) / 1000 AS DECIMAL(9,6)) END AS latitude""",
    """CASE WHEN event_id % 211 = 0 THEN CAST(0 AS DECIMAL(9,6))
       ELSE CAST(CAST(135000 + event_id % 5000 AS DOUBLE) / 1000 AS DECIMAL(9,6)) END AS longitude""",
    "CAST(get_json_object(props, '$.k') AS SMALLINT) AS battery_level",
    "CAST(ts AS TIMESTAMP) AS recorded_at",
    "CAST(ts + INTERVAL '1' SECOND * (event_id % 90) AS TIMESTAMP) AS ingested_at",
    """CASE WHEN event_id % 10 = 0 THEN NULL
       ELSE CAST(CAST((event_id * 7919) % 20001 - 10000 AS DOUBLE) / 1000 AS DECIMAL(7,3))
       END AS acceleration""",
    """CASE event_id % 7 WHEN 1 THEN 'clear' WHEN 2 THEN 'rain' WHEN 3 THEN 'SNOW'
       WHEN 4 THEN 'Fog' WHEN 5 THEN 'wind' WHEN 6 THEN 'fog' END AS weather""",
    "CASE event_id % 3 WHEN 1 THEN TRUE WHEN 2 THEN FALSE END AS engine_on",
)


def raw_table(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def raw_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a stream of files."""
    schema = raw_table(spark, sf_dir).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


def as_events(raw: DataFrame) -> DataFrame:
    """Vehicle events without labels or partition columns."""
    return raw.selectExpr(*EVENT_COLUMNS)


def untagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(raw_table(spark, sf_dir))


def vehicle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicle events with their labels."""
    return tag(untagged_events(spark, sf_dir))


def partitioned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_partitions(vehicle_events(spark, sf_dir))


def vehicle_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        raw_table(spark, sf_dir)
        .groupBy("user_id")
        .agg(F.min(F.col("ts").cast("timestamp")).alias("created_at"))
        .selectExpr(
            "user_id AS id",
            "user_id % 5 AS fleet_id",
            "concat('VIN-', user_id) AS vin",
            "CAST(NULL AS STRING) AS model",
            "created_at",
        )
    )


def fleet_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    vehicles = vehicle_table(spark, sf_dir)
    known = vehicles.filter(F.col("fleet_id") < KNOWN_FLEETS)
    return known.groupBy("fleet_id").agg(F.min("created_at").alias("created_at")).selectExpr(
        "fleet_id AS id",
        "concat('Fleet ', fleet_id) AS name",
        "sha2(concat('key-', fleet_id), 256) AS api_key_hash",
        "created_at",
        "TRUE AS is_active",
    )


def alert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One earlier overspeed alert per even vehicle; every second one is acknowledged."""
    vehicles = vehicle_table(spark, sf_dir)
    return vehicles.filter("id % 2 = 0").select(
        F.concat(F.lit("alert-"), F.col("id")).alias("alert_id"),
        "fleet_id",
        F.col("id").alias("vehicle_id"),
        F.lit("OVERSPEED").alias("alert_type"),
        F.lit("WARNING").alias("severity"),
        F.lit("{}").alias("payload"),
        (F.col("id") % 4 == 0).alias("acknowledged"),
        F.lit(AS_OF - timedelta(days=1)).alias("triggered_at"),
    )


def version_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return untagged_events(spark, sf_dir).drop("acceleration", "weather", "engine_on")


def version_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels missing on every fourth event."""
    events = vehicle_events(spark, sf_dir)
    return events.withColumn("scenarios", F.when(F.col("id") % 4 != 0, F.col("scenarios")))


def old_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier rollup whose numbers are stale, and one bucket per vehicle without events."""
    from roadledger.operators.hourly import rollup_rows

    events = untagged_events(spark, sf_dir)
    before = events.filter(F.col("recorded_at") < F.lit(OLD_ROLLUP_END))
    stale = rollup_rows(before, OLD_ROLLUP_END).withColumn("event_count", F.lit(0))
    empty = events.groupBy("fleet_id", "vehicle_id").agg(F.lit(1).alias("event_count")).select(
        "fleet_id",
        "vehicle_id",
        F.lit(datetime(2023, 12, 31, 5, tzinfo=timezone.utc)).alias("hour_bucket"),
        F.lit(50).cast(SPEED).alias("avg_speed"),
        F.lit(60).cast(SPEED).alias("max_speed"),
        F.lit(40).cast("smallint").alias("min_battery"),
        "event_count",
        F.lit(OLD_ROLLUP_END).alias("computed_at"),
        F.lit(datetime(2023, 12, 31).date()).alias("bucket_date"),
    )
    return stale.unionByName(empty)


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_table(spark, sf_dir).selectExpr(
        "event_type AS endpoint",
        "value / 1000 AS duration",
        "CASE WHEN event_type = 'error' THEN 429 ELSE 201 END AS status",
        "event_id % 3 = 0 AS hit",
        "CAST(ts AS TIMESTAMP) AS requested_at",
    )


def landing_rows(events: DataFrame) -> DataFrame:
    """The events as raw text rows in which fixed shares carry one defect or two."""
    return events.select(
        "id",
        F.col("fleet_id").cast("string"),
        F.col("vehicle_id").cast("string"),
        F.expr(
            "CASE WHEN id % 41 = 1 THEN '999' WHEN id % 41 = 2 THEN '-1' "
            "WHEN id % 41 = 3 THEN '10.123' WHEN id % 41 = 4 THEN 'fast' "
            "ELSE CAST(speed AS STRING) END"
        ).alias("speed"),
        F.expr(
            "CASE WHEN id % 43 = 1 THEN '90.5' WHEN id % 43 = 2 THEN NULL "
            "ELSE CAST(latitude AS STRING) END"
        ).alias("latitude"),
        F.expr(
            "CASE WHEN id % 47 = 1 THEN '-180.000001' WHEN id % 47 = 2 THEN '135.1234567' "
            "ELSE CAST(longitude AS STRING) END"
        ).alias("longitude"),
        F.expr(
            "CASE WHEN id % 53 = 1 THEN '101' WHEN id % 53 = 2 THEN '65.5' "
            "ELSE CAST(battery_level AS STRING) END"
        ).alias("battery_level"),
        F.expr(
            "CASE WHEN id % 59 = 1 THEN date_format(recorded_at, \"yyyy-MM-dd'T'HH:mm:ss\") "
            "WHEN id % 59 = 2 THEN '2024-01-31T00:05:01Z' "
            "WHEN id % 59 = 3 THEN '2024-01-31T00:05:00Z' "
            "WHEN id % 59 = 4 THEN "
            "date_format(recorded_at + INTERVAL 9 HOURS, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") || '+09:00' "
            "ELSE date_format(recorded_at, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") || 'Z' END"
        ).alias("recorded_at"),
        F.col("acceleration").cast("string"),
        F.expr("CASE WHEN id % 61 = 1 THEN repeat('x', 65) ELSE weather END").alias("weather"),
        F.col("engine_on").cast("string"),
        F.col("ingested_at").alias("arrived_at"),
    )


def json_landing(spark: SparkSession, sf_dir: str, path: str) -> str:
    """The events as JSON lines with UUID keys: times as text, seconds or milliseconds, numbers as
    numbers or text, half of the rows stamped on receipt, fixed shares broken or with a bad key."""
    key = "concat('00000000-0000-4000-8000-', lpad(CAST({0} AS STRING), 12, '0'))"
    events = untagged_events(spark, sf_dir).selectExpr(
        "id",
        f"CASE WHEN id % 71 = 1 THEN 'fleet-1' WHEN id % 7 = 1 THEN upper(replace({key.format('fleet_id')}, '-', '')) ELSE {key.format('fleet_id')} END AS fleet_id",
        f"{key.format('vehicle_id')} AS vehicle_id",
        "speed", "latitude", "longitude", "battery_level",
        """CASE id % 3 WHEN 0 THEN concat('"', date_format(recorded_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), 'Z"')
           WHEN 1 THEN CAST(CAST(CAST(unix_micros(recorded_at) AS DECIMAL(20,0)) / 1000000 AS DECIMAL(20,6)) AS STRING)
           ELSE CAST(unix_micros(recorded_at) DIV 1000 AS STRING) END AS moment""",
        "date_format(ingested_at, \"yyyy-MM-dd'T'HH:mm:ss\") AS received",
    )
    lines = events.selectExpr(
        "id",
        """concat('{"fleet_id": "', fleet_id, '", "vehicle_id": "', vehicle_id, '", "speed": ',
           IF(id % 2 = 0, CAST(speed AS STRING), concat('"', speed, '"')), ', "latitude": ', latitude,
           ', "longitude": ', longitude, ', "battery_level": ', battery_level, ', "recorded_at": ', moment,
           IF(id % 2 = 0, concat(', "received_at": "', received, 'Z"'), ''), '}') AS line""",
    )
    lines.selectExpr("IF(id % 97 = 1, left(line, 40), line) AS value").write.text(path)
    return path
