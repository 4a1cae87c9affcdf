"""Event table, dimensions, rollup table, upgrades and table checks."""

import json
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadledger import schemas
from roadledger.functions import expressions as X
from roadledger.operators import hourly, quality, rollup
from roadledger.operators.filters import between, hour_slice
from roadledger.sources import events as source
from roadledger.sources import fixtures as fx
from roadledger.sources import layers, tables, upgrade
from roadledger.streaming import rollup as stream_rollup

UTC = timezone.utc
EVENT = (
    "id long, fleet_id long, vehicle_id long, recorded_at timestamp, speed decimal(6,2), "
    "latitude decimal(9,6), longitude decimal(9,6), battery_level smallint"
)


def event(number, moment, speed="50.00", vehicle=1, battery=80, fleet=0):
    where = (Decimal("35.0"), Decimal("139.0"))
    return (number, fleet, vehicle, moment, Decimal(speed), *where, battery)


def full(spark, rows):
    """Events as an append takes them, with empty enrichment columns."""
    return upgrade.upgrade(spark.createDataFrame(rows, EVENT))


def at(day, hour, minute=0):
    return datetime(2024, 1, day, hour, minute, tzinfo=UTC)


def test_same_batch_twice_is_one_append(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = full(spark, [event(1, at(1, 5)), event(2, at(31, 23, 59))])
    for batch in ("a", "a", "b"):
        source.append_events(rows, path, batch)
    stored = source.read_events(spark, path)
    assert stored.count() == 4
    assert set(schemas.events().names) <= set(stored.columns)
    assert stored.filter("ingested_at IS NULL OR scenarios IS NULL").count() == 0


def test_compaction_leaves_few_files_and_counts_a_rewritten_batch_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "events")

    def files():
        return len([f for f in (tmp_path / "events").rglob("*.parquet") if "_versions" not in str(f)])

    def ids():
        return sorted(r.id for r in source.read_events(spark, path).collect())

    for k in range(24):
        source.append_events(full(spark, [event(k, at(1 + k % 2, 5))]), path, f"{k:03}")
    assert files() == 24 and source.compact_events(spark, path) and ids() == list(range(24))
    # A retry of a folded batch, before and after its folder is gone; a batch that comes later.
    source.append_events(full(spark, [event(3, at(2, 5))]), path, "003")
    source.clean_events(spark, path)
    source.append_events(full(spark, [event(3, at(2, 5))]), path, "003")
    assert files() == 2 and ids() == list(range(24))
    source.append_events(full(spark, [event(24, at(1, 5)), event(25, at(9, 5))]), path, "3")
    assert ids() == list(range(26)) and not source.compact_events(spark, path)

    commit = layers.VersionLog.commit

    def meanwhile(self, session, change):
        monkeypatch.setattr(layers.VersionLog, "commit", commit)
        source.append_events(full(spark, [event(26, at(9, 6))]), path, "late/one")
        return commit(self, session, change)

    monkeypatch.setattr(layers.VersionLog, "commit", meanwhile)
    assert source.compact_events(spark, path, at_least=1, parts_per_date=1) and ids() == list(range(27))
    assert source.compact_events(spark, path, at_least=1) and ids() == list(range(27))
    source.clean_events(spark, path)
    assert ids() == list(range(27)) and files() == 4
    assert layers.VersionLog(path).newest(spark).changes == []

    def twice(self, session, change):
        monkeypatch.setattr(layers.VersionLog, "commit", commit)
        source.compact_events(spark, path, at_least=1)
        return commit(self, session, change)

    source.append_events(full(spark, [event(27, at(9, 6))]), path, "more")
    monkeypatch.setattr(layers.VersionLog, "commit", twice)
    with pytest.raises(layers.Conflict):
        source.compact_events(spark, path, at_least=1)
    assert ids() == list(range(28))


def test_names_keep_running_numbers_as_ranges():
    names = layers.Names()
    for name in ("a-3", "a-1", "a-2", "b", "a-2", "2024-01-31", "a-007", "9", "x\n1"):
        names.add(name)
    assert names.ranges["a-"] == [[1, 3]]
    kept = layers.Names(json.loads(json.dumps(names.ranges)))
    assert all(name in kept for name in ("a-1", "a-2", "a-3", "b", "2024-01-31", "a-007", "9", "x\n1"))
    assert not any(name in kept for name in ("a-0", "a-4", "a-7", "a-07", "b0", "", "2024-01-30", "09", "x"))


def test_time_bounds_skip_directories(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [event(i, datetime(2024, m, 10, tzinfo=UTC)) for i, m in enumerate(range(1, 7))]
    source.append_events(full(spark, rows), path, "a")
    found = between(
        source.read_events(spark, path), datetime(2024, 2, 1), datetime(2024, 4, 1)
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    pruned = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "event_month" in pruned and "event_date" in pruned
    assert "GreaterThanOrEqual(recorded_at" in plan
    assert found.count() == 2


def test_hour_slice_rolls_over_midnight(spark):
    rows = [event(1, at(1, 23)), event(2, at(1, 23, 59)), event(3, at(2, 0))]
    found = hour_slice(spark.createDataFrame(rows, EVENT), at(1, 23, 30))
    assert sorted(r.id for r in found.collect()) == [1, 2]


def test_untagged_and_defaults(spark):
    rows = spark.createDataFrame([event(1, at(1, 1))], EVENT).withColumn(
        "scenarios", F.array(F.lit("hard_brake"))
    )
    assert source.untagged(rows).first().scenarios == []
    filled = source.with_defaults(rows.drop("id", "scenarios"), at(3, 3))
    first = filled.select("id", "scenarios", F.col("ingested_at").cast("string").alias("t")).first()
    assert len(first.id) == 36 and first.scenarios == [] and first.t == "2024-01-03 03:00:00"


def test_versions_read_together(spark, tmp_path):
    one, two = str(tmp_path / "v1"), str(tmp_path / "v2")
    spark.createDataFrame([event(1, at(1, 1))], EVENT).write.parquet(one)
    newer = spark.createDataFrame([event(2, at(1, 1))], EVENT).selectExpr(
        "*", "CAST(-8 AS DECIMAL(7,3)) AS acceleration", "'rain' AS weather",
        "true AS engine_on", "CAST(NULL AS ARRAY<STRING>) AS scenarios",
    )
    newer.write.parquet(two)
    both = upgrade.fill_labels(upgrade.read_all_versions(spark, one, two))
    rows = {r.id: r for r in both.collect()}
    assert rows[1].acceleration is None and rows[1].scenarios == [] and rows[2].scenarios == []
    assert rows[2].weather == "rain"
    assert upgrade.drop_enrichment(newer).columns == spark.createDataFrame([], EVENT).columns


def test_exact_mean_rounds_once(spark):
    """True mean 1.004999997: rounding the six-decimal mean again would give 1.01."""
    n = 333_333_333
    total = Decimal(n) * Decimal("1.005") - Decimal("0.67")
    df = spark.range(1).select(
        X.exact_mean(F.lit(total.quantize(Decimal("0.01"))), F.lit(n)).alias("m")
    )
    assert df.first().m == Decimal("1.00")


def test_upsert_twice_is_once_and_late_events_change_only_their_bucket(spark, tmp_path):
    events, table = str(tmp_path / "events"), str(tmp_path / "hourly")
    first = full(spark, [
        event(1, at(1, 5, 10), "10"), event(2, at(1, 5, 20), "20"),
        event(3, at(1, 6), "30"), event(4, at(2, 7), "40"),
    ])
    source.append_events(first, events, "first")
    for number in (1, 1, 2):
        stream_rollup.refresh_rollup(first, events, table, "job", number)
    key = first.schema["fleet_id"].dataType
    before = {r.hour_bucket: r for r in tables.read_rollup_table(spark, table, key).collect()}
    assert len(before) == 3

    late = full(spark, [event(5, at(1, 5, 59), "61", battery=5)])
    source.append_events(late, events, "late")
    stream_rollup.refresh_rollup(late, events, table, "job", 3)
    after = {r.hour_bucket: r for r in tables.read_rollup_table(spark, table, key).collect()}
    changed = {hour for hour in after if after[hour] != before[hour]}
    assert len(after) == 3 and len(changed) == 1
    row = after[changed.pop()]
    assert (row.avg_speed, row.max_speed, row.min_battery, row.event_count) == (
        Decimal("30.33"), Decimal("61.00"), 5, 3,
    )


def test_an_upsert_writes_only_its_own_rows(spark, tmp_path):
    table = str(tmp_path / "hourly")
    rows = full(spark, [event(k, at(1 + k % 20, k % 24), vehicle=k) for k in range(500)])
    tables.upsert_rollup(hourly.rollup_rows(rows), table, "load")
    fresh = hourly.rollup_rows(rows.filter("id = 7").withColumn("speed", F.lit(99).cast("decimal(6,2)")))
    assert tables.upsert_rollup(fresh, table, "job") and not tables.upsert_rollup(fresh, table, "job")
    assert spark.read.parquet(f"{table}/changes/change=job-0").count() == 1
    stored = tables.read_rollup_table(spark, table, T.LongType())
    assert stored.count() == 500 and stored.filter("max_speed = 99").count() == 1
    one_day = stored.filter(F.col("bucket_date") == F.lit(date(2024, 1, 3)))._jdf.queryExecution().executedPlan().toString()
    assert one_day.count("bucket_date") > 2 and "PartitionFilters: []" not in one_day


def test_an_upsert_that_died_halfway_is_put_in_when_run_again(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "hourly")
    rows = full(spark, [event(1, at(1, 5)), event(2, at(1, 9), vehicle=2)])
    tables.upsert_rollup(hourly.rollup_rows(rows), table, "load")
    fresh = hourly.rollup_rows(rows.filter("id = 1").withColumn("speed", F.lit(99).cast("decimal(6,2)")))
    key = T.LongType()

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(layers.VersionLog, "commit", dies)
    with pytest.raises(RuntimeError):
        tables.upsert_rollup(fresh, table, "job")
    with pytest.raises(RuntimeError):
        tables.rollup_table(table).compact(spark, fresh.schema)
    monkeypatch.undo()
    # What was written is not named by any version.
    assert sorted(r.max_speed for r in tables.read_rollup_table(spark, table, key).collect()) == [50, 50]
    assert tables.upsert_rollup(fresh, table, "job")
    assert tables.rollup_table(table).compact(spark, fresh.schema)
    stored = tables.read_rollup_table(spark, table, key)
    assert sorted(r.max_speed for r in stored.collect()) == [50, 99]
    tables.rollup_table(table).clean(spark, keep=1)
    assert len(list((tmp_path / "hourly" / "base" / "bucket_date=2024-01-01").glob("generation=*"))) == 1
    assert not list((tmp_path / "hourly" / "changes").glob("change=*"))
    assert sorted(r.max_speed for r in tables.read_rollup_table(spark, table, key).collect()) == [50, 99]


def test_compaction_and_writers_keep_each_others_rows(spark, tmp_path, monkeypatch):
    table, key = str(tmp_path / "hourly"), T.LongType()
    rows = full(spark, [event(k, at(k, 5)) for k in range(1, 6)])
    for k in range(1, 4):
        tables.upsert_rollup(hourly.rollup_rows(rows.filter(f"id = {k}")), table, "a", k)
    layered, schema = tables.rollup_table(table), schemas.hourly(key)
    commit = layers.VersionLog.commit

    def meanwhile(self, session, change):
        """Another writer commits between this compaction's read and its own commit."""
        monkeypatch.setattr(layers.VersionLog, "commit", commit)
        late = rows.filter("id IN (2, 4)").withColumn("speed", F.lit(77).cast("decimal(6,2)"))
        tables.upsert_rollup(hourly.rollup_rows(late), table, "b")
        return commit(self, session, change)

    monkeypatch.setattr(layers.VersionLog, "commit", meanwhile)
    assert layered.compact(spark, schema)
    version = layered.log.newest(spark)
    assert version.changes == ["b-0"] and version.writers == {"a": 3, "b": 0}
    found = {r.bucket_date.day: int(r.max_speed) for r in tables.read_rollup_table(spark, table, key).collect()}
    assert found == {1: 50, 2: 77, 3: 50, 4: 77}

    def twice(self, session, change):
        monkeypatch.setattr(layers.VersionLog, "commit", commit)
        layered.compact(spark, schema)
        return commit(self, session, change)

    monkeypatch.setattr(layers.VersionLog, "commit", twice)
    with pytest.raises(layers.Conflict):
        layered.compact(spark, schema)
    found = {r.bucket_date.day: int(r.max_speed) for r in tables.read_rollup_table(spark, table, key).collect()}
    assert found == {1: 50, 2: 77, 3: 50, 4: 77}


def test_two_writers_cannot_commit_the_same_version(spark, tmp_path, monkeypatch):
    layered = layers.Layered(str(tmp_path / "t"), ("k",))
    rows = spark.createDataFrame([(1, "x")], "k int, v string")
    seen = layers.VersionLog.newest
    old = [seen(layered.log, spark)]
    layered.append(rows, "a")
    # A writer that has read the version before the other's commit tries again on the newer one.
    monkeypatch.setattr(layers.VersionLog, "newest", lambda self, session: old.pop() if old else seen(self, session))
    layered.log.commit(spark, lambda now: layers.replace(now, writers={**now.writers, "b": 5}))
    monkeypatch.undo()
    version = layered.log.newest(spark)
    assert version.number == 2 and version.writers == {"a": 0, "b": 5} and version.changes == ["a-0"]


def test_changes_without_a_key_are_all_kept_and_a_table_without_changes_is_empty(spark, tmp_path):
    layered = layers.Layered(str(tmp_path / "t"))
    rows = spark.createDataFrame([(1, "x"), (1, "x")], "k int, v string")
    assert layered.read(spark, rows.schema).count() == 0 and not layered.compact(spark, rows.schema)
    for number in range(3):
        layered.append(rows, "writer with / odd name", number)
    assert layered.read(spark, rows.schema).count() == 6
    layered.compact(spark, rows.schema)
    layered.append(rows, "other")
    assert layered.read(spark, rows.schema).count() == 8


def test_upsert_keeps_other_dates(spark, tmp_path):
    table = str(tmp_path / "hourly")
    rows = full(spark, [event(1, at(1, 5)), event(2, at(2, 5))])
    tables.upsert_rollup(hourly.rollup_rows(rows), table, "load")
    fresh = hourly.rollup_rows(rows.filter("id = 2"), at(9, 9))
    tables.upsert_rollup(fresh, table, "job", compact_after=1)
    stamps = tables.read_rollup_table(spark, table, T.LongType()).groupBy("bucket_date").agg(F.max("computed_at").alias("c"))
    found = {r.bucket_date: r.c for r in stamps.collect()}
    assert set(found) == {date(2024, 1, 1), date(2024, 1, 2)}
    assert found[date(2024, 1, 1)] > found[date(2024, 1, 2)]


def test_scattered_hours_still_skip_other_dates(spark, tmp_path):
    path = str(tmp_path / "events")
    days = [datetime(2024, 1, 1, 5, tzinfo=timezone.utc) + timedelta(days=k) for k in range(150)]
    source.append_events(full(spark, [event(k, day) for k, day in enumerate(days)]), path, "a")
    stored = source.read_events(spark, path)
    touched = stored.filter(rollup.in_hours(days[::2], dated=True))
    assert sorted(r.id for r in touched.collect()) == list(range(0, 150, 2))
    plan = touched._jdf.queryExecution().executedPlan()
    plan.execute()
    files = touched.select(F.input_file_name()).distinct().count()
    assert files == 75 and "event_date" in plan.toString().split("PartitionFilters")[1].split("PushedFilters")[0]
    assert stored.filter(rollup.in_hours([], dated=True)).count() == 0


def test_recompute_reads_only_the_touched_dates(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = full(spark, [event(day, at(day, 5)) for day in range(1, 20)])
    source.append_events(rows, path, "a")
    touched = rollup.affected_buckets(rows.filter("id IN (3, 4, 17)"))
    fresh = rollup.recompute(source.read_events(spark, path), touched)
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = fresh._jdf.queryExecution().explainString(formatted)
    pruned = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert all(f"2024-01-{day:02}" in pruned for day in (3, 4, 17)) and "2024-01-05" not in pruned
    assert sorted(r.bucket_date.day for r in fresh.collect()) == [3, 4, 17]


def test_rollup_of_one_hour_and_no_data(spark):
    rows = full(spark, [event(1, at(1, 5)), event(2, at(1, 6))])
    assert hourly.rollup_for_hour(rows, at(1, 5)).count() == 1
    assert hourly.rollup_for_hour(rows, at(1, 5), vehicle_id=7).count() == 0


def test_insert_if_absent(spark, tmp_path):
    path = str(tmp_path / "vehicles")
    rows = [(1, 0, "A", 5), (2, 0, "A", 3), (3, 0, None, 1), (4, 0, None, 1)]
    new = spark.createDataFrame(rows, "id int, fleet_id int, vin string, seen int")
    for _ in range(2):
        tables.insert_if_absent(new.filter("vin IS NOT NULL"), path, ("fleet_id", "vin"), ("seen",))
    assert [r.id for r in spark.read.parquet(path).collect()] == [2]
    # Null keys never conflict.
    assert tables.only_new(new, spark.read.parquet(path), ("fleet_id", "vin")).count() == 2


def test_quality_checks(spark):
    vehicles = spark.createDataFrame(
        [(1, 0, "A"), (2, 0, "A"), (3, 9, "B"), (4, None, "C")], "id int, fleet_id int, vin string"
    )
    fleets = spark.createDataFrame([(0,)], "id int")
    broken = quality.duplicates(vehicles, quality.UNIQUE_KEYS["vehicles"]).collect()
    assert [(r.vin, r.row_count) for r in broken] == [("A", 2)]
    assert [r.id for r in quality.orphans(vehicles, fleets).collect()] == [3]
    assert sorted(r.id for r in quality.without_fleets(vehicles, fleets).collect()) == [3, 4]


def test_missing_months(spark, data_dir):
    coverage = quality.month_coverage(fx.partitioned_events(spark, data_dir), fx.AS_OF, 2, 1)
    missing = quality.missing_months(coverage).orderBy("event_month").collect()
    assert [r.event_month for r in missing] == ["2023-11", "2023-12", "2024-02"]


def test_json_export(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, Decimal("1.50"), at(1, 5), None)], "a int, b decimal(6,2), t timestamp, n string"
    ).withColumn("u", F.expr("t + INTERVAL 1500 MILLISECOND"))
    text = json.loads(X.to_json_rows(rows).first().json)
    assert text == {
        "a": 1, "b": 1.5, "t": "2024-01-01T05:00:00+00:00", "n": None,
        "u": "2024-01-01T05:00:01.500000+00:00",
    }
    source.write_json(rows, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value) == text


def test_key_digest(spark):
    import hashlib

    df = spark.createDataFrame([("secret",)], "k string").select(X.key_digest("k").alias("d"))
    assert df.first().d == hashlib.sha256(b"secret").hexdigest()
