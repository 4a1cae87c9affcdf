"""Ingest, rollup and latest-state streams on landing files that arrive in steps."""

import json
import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from roadledger import schemas
from roadledger.operators import hourly, latest
from roadledger.operators.admission import TokenBucket
from roadledger.sources import events as source
from roadledger.sources import tables
from roadledger.streaming import alerts, ingest, rollup
from roadledger.streaming import latest as stream_latest

FLEET = "00000000-0000-4000-8000-00000000000%d"
START = datetime(2025, 3, 15, 10, tzinfo=timezone.utc)


def landing_file(folder, name, moments, fleet=1, **changes):
    os.makedirs(folder, exist_ok=True)
    lines = []
    for number, moment in enumerate(moments):
        row = {
            "fleet_id": FLEET % fleet, "vehicle_id": FLEET % (number % 3), "speed": "133.75",
            "latitude": "48.137250", "longitude": "11.575500", "battery_level": 41,
            "recorded_at": moment.isoformat(),
        }
        lines.append(json.dumps({**row, **changes}))
    with open(os.path.join(folder, name), "w") as out:
        out.write("\n".join(lines))


def minutes(count, step=20, first=0):
    return [START + timedelta(minutes=step * (first + k)) for k in range(count)]


def run_all(spark, landing, root, bucket=TokenBucket()):
    paths = ingest.IngestPaths(root)
    stream = source.stream_landing(spark, landing, maxFilesPerTrigger=1)
    ingest.start_ingest(stream, paths, bucket).awaitTermination()
    if os.path.isdir(paths.events):
        appended = source.stream_events(spark, paths.events)
        rollup.start_rollup(
            appended, paths.events, f"{root}/hourly", f"{root}/rollup-checkpoint"
        ).awaitTermination()
    return paths


def stored_rollup(spark, root):
    rows = tables.read_rollup_table(spark, f"{root}/hourly")
    return sorted(tuple(r) for r in rows.select(*hourly.BUCKET, *hourly.MEASURES).collect())


def batch_rollup(spark, paths):
    rows = hourly.rollup_rows(source.read_events(spark, paths.events))
    return sorted(tuple(r) for r in rows.select(*hourly.BUCKET, *hourly.MEASURES).collect())


def test_ingest_and_rollup_follow_the_landing_folder(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "job")
    landing_file(landing, "a.json", minutes(9))
    landing_file(landing, "b.json", minutes(4), speed=999)
    paths = run_all(spark, landing, root)
    events = source.read_events(spark, paths.events)
    assert events.count() == 9 and events.select("id").distinct().count() == 9
    assert {tuple(r.scenarios) for r in events.collect()} == {("over_speeding",)}
    refused = spark.read.parquet(paths.quarantine)
    assert [r.reasons for r in refused.collect()] == [["speed_range"]] * 4
    counts = {r.status: r.event_count for r in ingest.read_outcomes(spark, paths).collect()}
    assert counts == {"success": 9, "invalid": 4}
    assert stored_rollup(spark, root) == batch_rollup(spark, paths)

    # Late events, a repeated payload (a new event each time) and an earlier month.
    landing_file(landing, "c.json", minutes(5) + minutes(1) + minutes(1, first=-3 * 24 * 30))
    paths = run_all(spark, landing, root)
    assert source.read_events(spark, paths.events).count() == 16
    assert stored_rollup(spark, root) == batch_rollup(spark, paths)


def test_repeated_batch_changes_nothing(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "job")
    landing_file(landing, "a.json", minutes(6))
    paths = ingest.IngestPaths(root)
    raw = source.read_landing(spark, landing)
    bucket = TokenBucket(4, 1, 3600)
    for _ in range(3):
        ingest.ingest_batch(raw, 0, paths, bucket)
        rows = source.read_events(spark, paths.events).select("id").collect()
        counts = {r.status: r.event_count for r in ingest.read_outcomes(spark, paths).collect()}
        assert len(rows) == 4 and counts == {"success": 4, "rate_limited": 2}
    first = {r.id for r in rows}
    ingest.ingest_batch(raw, 0, paths, bucket)
    assert {r.id for r in source.read_events(spark, paths.events).collect()} == first
    # The bucket is empty for the next batch, full again after an hour without events.
    ingest.ingest_batch(raw, 1, paths, bucket)
    assert source.read_events(spark, paths.events).count() == 4
    later = raw.withColumn("arrived_at", F.expr("arrived_at + INTERVAL 2 HOURS"))
    ingest.ingest_batch(later, 2, paths, bucket)
    assert source.read_events(spark, paths.events).count() == 8


def test_nothing_but_refused_rows(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "job")
    landing_file(landing, "a.json", minutes(3), battery_level=None)
    paths = run_all(spark, landing, root)
    counts = {r.status: r.event_count for r in ingest.read_outcomes(spark, paths).collect()}
    assert counts == {"invalid": 3}


def test_latest_state_over_several_batches(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "job")
    paths = ingest.IngestPaths(root)
    for step, first in enumerate((5, 0, 9)):
        landing_file(landing, f"{step}.json", minutes(4, first=first))
        paths = run_all(spark, landing, root)
        stream_latest.start_latest(
            source.stream_events(spark, paths.events), f"{root}/latest", f"{root}/latest-checkpoint"
        ).awaitTermination()
        found = stream_latest.read_latest(spark, f"{root}/latest")
        wanted = latest.latest_events(source.read_events(spark, paths.events))
        order = wanted.columns
        assert sorted(map(tuple, found.select(*order).collect())) == sorted(
            map(tuple, wanted.collect())
        )


def test_alert_scan(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "job")
    landing_file(landing, "a.json", minutes(6, step=1), speed=250)
    paths = run_all(spark, landing, root)
    log, now = f"{root}/alerts", START + timedelta(minutes=6)
    created = [
        alerts.scan_for_alerts(spark, paths.events, log, lookback_minutes=30, as_of=moment)
        for moment in (now, now, now + timedelta(minutes=1))
    ]
    assert created == [3, 0, 0]
    assert spark.read.parquet(log).select("alert_id").distinct().count() == 3


def test_windowed_rollup_drops_only_what_is_too_late(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "id int, fleet_id int, vehicle_id int, recorded_at timestamp, speed decimal(6,2), battery_level smallint"
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    steps = [[0, 30, 300], [240], [10]]
    for step, offsets in enumerate(steps):
        rows = spark.range(1).select(
            F.explode(F.array(*[F.lit(START + timedelta(minutes=m)) for m in offsets])).alias("recorded_at")
        ).selectExpr(
            "1 AS id", "0 AS fleet_id", "1 AS vehicle_id", "recorded_at",
            "CAST(50 AS DECIMAL(6,2)) AS speed", "CAST(9 AS SMALLINT) AS battery_level",
        )
        rows.coalesce(1).write.mode("append").parquet(folder)
        (
            rollup.windowed_rollup(spark.readStream.schema(schema).parquet(folder))
            .writeStream.outputMode("update")
            .foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{out}/b={n}"))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    newest = spark.read.parquet(out).groupBy("hour_bucket").agg(F.max("event_count").alias("n"))
    counts = sorted((r.hour_bucket.hour, r.n) for r in newest.collect())
    assert counts == [(10, 2), (14, 1), (15, 1)]


def test_what_the_watermark_drops_is_recomputed(spark, tmp_path):
    """Late rows, a repeated batch and a batch of nothing but late rows; every bucket stays right."""
    landing, root = str(tmp_path / "landing"), str(tmp_path / "job")
    paths, lates = ingest.IngestPaths(root), []
    for step, moments in enumerate((minutes(6), minutes(4, first=30), minutes(3, first=1), minutes(2, first=2) + minutes(2, first=34))):
        landing_file(landing, f"{step}.json", moments)
        ingest.start_ingest(source.stream_landing(spark, landing, maxFilesPerTrigger=1), paths).awaitTermination()
        for _ in range(2):
            rollup.start_windowed_rollup(
                source.stream_events(spark, paths.events), paths.events, f"{root}/hourly", f"{root}/windows"
            ).awaitTermination()
        late = rollup.read_late(spark, f"{root}/windows")
        lates.append(late.count())
        assert stored_rollup(spark, root) == batch_rollup(spark, paths)
    # Vehicles 0 to 2 at 10:20, 10:40 and 11:00, later 0 and 1 at 10:40 and 11:00.
    assert lates == [0, 0, 3, 5]


def test_an_event_sent_twice_is_stored_once_and_counted(spark, tmp_path):
    """Within a file, in a later file, broken ones too; a changed field makes another event."""
    landing, paths = str(tmp_path / "landing"), ingest.IngestPaths(str(tmp_path / "job"))
    steps = [minutes(4) + minutes(2, first=3), minutes(3, first=2), minutes(2, first=2)]
    for step, moments in enumerate(steps):
        landing_file(landing, f"{step}.json", moments, **({"speed": "12"} if step == 2 else {}))
        ingest.start_ingest(
            source.stream_landing(spark, landing, maxFilesPerTrigger=1), paths, repeats_within="1 day"
        ).awaitTermination()
    # Vehicle numbers go round by three within a file, so a repeat is the same time and vehicle.
    sent = [(m, k % 3, "12" if step == 2 else "133.75") for step, moments in enumerate(steps) for k, m in enumerate(moments)]
    stored = source.read_events(spark, paths.events)
    assert stored.count() == len(set(sent))
    counts = {r.status: r.event_count for r in ingest.read_outcomes(spark, paths).collect()}
    assert counts.get("duplicate", 0) == len(sent) - len(set(sent)) and counts["success"] == len(set(sent))


def test_streams_follow_the_events_through_compaction(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "job")
    for step in range(4):
        landing_file(landing, f"{step}.json", minutes(3, first=step))
        paths = run_all(spark, landing, root)
        assert source.compact_events(spark, paths.events, at_least=1)
        source.clean_events(spark, paths.events)
        assert source.read_events(spark, paths.events).count() == 3 * (step + 1)
        assert stored_rollup(spark, root) == batch_rollup(spark, paths)


def test_latest_state_is_folded_and_never_goes_back(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "job")
    for step in range(5):
        landing_file(landing, f"{step}.json", minutes(3, first=(4 * step) % 5))
        paths = run_all(spark, landing, root)
        for checkpoint in ("one", f"fresh-{step}"):  # a query that starts over reads all events again
            stream_latest.start_latest(
                source.stream_events(spark, paths.events), f"{root}/latest", f"{root}/{checkpoint}", compact_after=2
            ).awaitTermination()
        wanted = latest.latest_events(source.read_events(spark, paths.events))
        found = stream_latest.read_latest(spark, f"{root}/latest").select(*wanted.columns)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    version = stream_latest.state_table(f"{root}/latest").log.newest(spark)
    assert len(version.base) == 1 and len(version.changes) < 2


def test_a_fresh_checkpoint_takes_nothing_from_old_stages(spark, tmp_path):
    class Fresh(ingest.IngestPaths):
        @property
        def checkpoint(self):
            return f"{self.root}/second-checkpoint"

    root = str(tmp_path / "job")
    for number, paths in enumerate((ingest.IngestPaths(root), Fresh(root))):
        landing = str(tmp_path / f"landing-{number}")
        landing_file(landing, "a.json", minutes(3, first=10 * number))
        for _ in range(2):  # the second start finds nothing new
            ingest.start_ingest(source.stream_landing(spark, landing), paths).awaitTermination()
    stored = source.read_events(spark, ingest.IngestPaths(root).events)
    assert stored.count() == 6 and stored.select("id").distinct().count() == 6


def test_a_later_batch_needs_the_buckets_before_it(spark, tmp_path):
    landing_file(str(tmp_path / "landing"), "a.json", minutes(2))
    raw = source.read_landing(spark, str(tmp_path / "landing")).withColumn("arrived_at", F.current_timestamp())
    with pytest.raises(FileNotFoundError):
        ingest.ingest_batch(raw, 3, ingest.IngestPaths(str(tmp_path / "job")))


def test_refused_events_are_kept(spark, tmp_path):
    paths = run_all(spark, str(_landing(tmp_path)), str(tmp_path / "job"), TokenBucket(2, 1, 3600))
    stored = source.read_events(spark, paths.events).count()
    refused = ingest.read_refused(spark, paths)
    assert stored + refused.count() == 6 and refused.count() > 0
    assert set(refused.columns) >= {"id", "fleet_id", "speed", "recorded_at", "ingested_at"}


def _landing(tmp_path):
    landing_file(str(tmp_path / "landing"), "a.json", minutes(6))
    return tmp_path / "landing"
