"""Token buckets: block-wise, salted and streamed forms against a plain sequential loop."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadledger.operators import admission
from roadledger.operators.admission import TokenBucket, _solve, admit, carried_over, grants
from roadledger.session import shared_dir, written
from roadledger.streaming.admission import STATE_STORE_CONF, stream_grants

EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)


def sequential(events, bucket, state=None):
    """One request at a time, in floating tokens, as a plain limiter does it."""
    rate = bucket.refill_tokens / bucket.refill_seconds
    state = {} if state is None else state
    allowed = set()
    for fleet, moment, event in sorted(events):
        second = int(moment.timestamp())
        tokens, last = state.get(fleet, (float(bucket.capacity), second))
        if second - last > bucket.idle_seconds:
            tokens = float(bucket.capacity)
        tokens = min(bucket.capacity, tokens + max(0, second - last) * rate)
        if tokens >= 1:
            allowed.add(event)
            tokens -= 1
        state[fleet] = (tokens, second)
    return allowed


def random_events(seed, count, span, fleets=4, first=0):
    """Fleet 0 gets half of all events, many of them in one second."""
    rng = random.Random(seed)
    events = []
    for event in range(first, first + count):
        fleet = 0 if rng.random() < 0.5 else rng.randrange(1, fleets)
        second = 7 if rng.random() < 0.2 else rng.randrange(span)
        moment = EPOCH + timedelta(seconds=second, microseconds=rng.randrange(1_000_000))
        events.append((fleet, moment, event))
    return events


def frame(spark, events):
    return spark.createDataFrame(events, "fleet_id long, ingested_at timestamp, id long")


def admitted_ids(spark, events, bucket, initial=None, block_seconds=50, **options):
    rows = frame(spark, events)
    granted = grants(rows, bucket, initial, block_seconds=block_seconds)
    table = written(granted, shared_dir(spark, "grants"))
    flagged = admit(rows, table, bucket, **options)
    assert flagged.count() == len(events)
    return {r.id for r in flagged.filter("admitted").collect()}, table


# Rates that are exact in binary, so that the floating loop does not drift.
BUCKETS = [
    TokenBucket(1, 1, 8),
    TokenBucket(3, 1, 64),
    TokenBucket(10, 3, 4),
    TokenBucket(10, 1, 16, idle_seconds=30),
    TokenBucket(100, 2, 1),
]


@pytest.mark.parametrize("bucket", BUCKETS)
@pytest.mark.parametrize("span", [40, 600])
def test_blocks_equal_the_sequential_loop(spark, bucket, span):
    events = random_events(span, 400, span)
    found, _ = admitted_ids(spark, events, bucket)
    assert found == sequential(events, bucket)


def test_crowded_seconds_are_dealt_out(spark):
    events = random_events(5, 600, 60)
    bucket = TokenBucket(20, 1, 4)
    found, _ = admitted_ids(spark, events, bucket, rows_per_salt=10)
    assert found == sequential(events, bucket)


@pytest.mark.parametrize("most", [0, 10**6])
@pytest.mark.parametrize("rows_per_salt", [25, 10**6])
def test_short_seconds_are_sent_to_the_events_or_shuffled(spark, monkeypatch, most, rows_per_salt):
    monkeypatch.setattr(admission, "BROADCAST_SECONDS", most)
    events = random_events(8, 500, 60)
    bucket = TokenBucket(20, 1, 4)
    found, table = admitted_ids(spark, events, bucket, rows_per_salt=rows_per_salt)
    assert found == sequential(events, bucket)
    free = written(grants(frame(spark, events), TokenBucket(10_000, 1, 4)), shared_dir(spark, "grants"))
    plan = admit(frame(spark, events), free, bucket)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_exact_thirds_do_not_drift(spark):
    """50/3 tokens per second: three seconds give exactly fifty tokens, whatever came before."""
    bucket = TokenBucket(1000, 1000, 60)
    events = [
        (0, EPOCH + timedelta(seconds=3 * k), 1000 * k + j) for k in range(40) for j in range(100)
    ]
    table = grants(frame(spark, events), bucket, block_seconds=30).orderBy("second").collect()
    assert [r.granted for r in table] == [100] * 19 + [50] * 21


@pytest.mark.parametrize("block_seconds", [50, 1000])
def test_carry_over_between_batches(spark, block_seconds):
    bucket = TokenBucket(10, 1, 4, idle_seconds=200)
    state, initial = {}, None
    for batch in range(3):
        events = [
            (f, m + timedelta(seconds=100 * batch), i)
            for f, m, i in random_events(batch, 200, 90, first=1000 * batch)
        ]
        found, table = admitted_ids(spark, events, bucket, initial, block_seconds)
        assert found == sequential(events, bucket, state)
        initial = written(carried_over(table, initial), shared_dir(spark, "levels"))


def test_hot_fleet_is_split_over_blocks(spark):
    """One fleet's timeline is walked by several tasks, not by one."""
    events = [(0, EPOCH + timedelta(seconds=s), s) for s in range(0, 2000)]
    table = grants(frame(spark, events), TokenBucket(3, 1, 64), block_seconds=100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = table.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) > 3 and sum(r["count"] for r in tasks) == 2000


def test_text_keys_and_no_events(spark):
    events = [(f"fleet-{f}", m, i) for f, m, i in random_events(3, 200, 300)]
    rows = spark.createDataFrame(events, "fleet_id string, ingested_at timestamp, id long")
    bucket = TokenBucket(3, 1, 16)
    for block_seconds in (50, 1000):
        table = grants(rows, bucket, block_seconds=block_seconds)
        total = table.agg(F.sum("granted")).first()[0]
        assert total == len(sequential(events, bucket))
    none = rows.limit(0)
    assert admit(none, grants(none, bucket), bucket).count() == 0


def test_bad_buckets_are_refused():
    with pytest.raises(ValueError):
        TokenBucket(capacity=0)


@pytest.mark.parametrize("bucket", [TokenBucket(1000, 7, 3600), TokenBucket(10**6, 10**5, 3600)])
def test_fine_buckets_are_solved_too(spark, bucket):
    events = [(0, EPOCH + timedelta(seconds=s // 40), s) for s in range(1200)]
    table = grants(frame(spark, events), bucket, block_seconds=5)
    level, granted = bucket.full, 0
    for s in range(30):
        level = min(bucket.full, level + (bucket.gain if s else 0))
        take = min(40, level // bucket.parts)
        level, granted = level - take * bucket.parts, granted + take
    assert table.agg(F.sum("granted")).first()[0] == granted


def test_a_block_is_solved_for_every_start():
    """The solved function against the bucket itself, from each possible level."""
    rng = random.Random(9)
    for _ in range(400):
        bucket = TokenBucket(rng.randrange(1, 9), rng.randrange(1, 5), rng.randrange(1, 8))
        gains = [0] + [min(bucket.full, rng.choice([0, 1, 2, 5, 50]) * bucket.gain) for _ in range(rng.randrange(0, 40))]
        costs = [bucket.parts * min(bucket.capacity + 1, rng.choice([1, 1, 1, 2, 3, 99])) for _ in gains]
        rows = pd.DataFrame({"fleet_id": 1, "block": 0, "gain": gains, "cost": costs})
        (solved,) = [r for part in _solve(bucket)(iter([rows])) for r in part.itertuples()]
        for start in range(bucket.full + 1):
            level = start
            for gain, cost in zip(gains, costs):
                level = min(bucket.full, level + gain)
                level -= bucket.parts * min(cost // bucket.parts, level // bucket.parts)
            if start < solved.low:
                at = sum(s <= start % bucket.parts for s in solved.starts) - 1
                found = solved.ends[at] + solved.slopes[at] * (start % bucket.parts - solved.starts[at])
            else:
                found = start + solved.shift if start <= solved.top else solved.capped
            assert found == level


def test_fleets_never_refused_run_no_python(spark):
    events = [(f, EPOCH + timedelta(seconds=40 * s), 1000 * f + s) for f in range(3) for s in range(100)]
    table = grants(frame(spark, events), TokenBucket(2, 1, 30), block_seconds=300)
    assert "MapIn" not in table._jdf.queryExecution().executedPlan().toString()
    assert table.filter("granted < requested").isEmpty() and table.count() == 300
    table = grants(frame(spark, events + events[:99]), TokenBucket(2, 1, 60), block_seconds=300)
    assert "MapInPandas" in table._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block_seconds", [20, 10**6])
def test_a_bucket_of_many_levels_is_split_like_any_other(spark, block_seconds):
    bucket = TokenBucket(5_000_000, 100_000, 7)
    assert bucket.full > 1 << 24
    rows = spark.range(60).selectExpr("1L AS fleet_id", "explode(sequence(0L, 1999L + id * 37L)) AS k", "id AS second")
    events = rows.selectExpr("fleet_id", "timestamp_seconds(second * 2) AS ingested_at", "k AS id")
    small = TokenBucket(20_000, 900, 7)
    found = {(r.second, r.granted, r.level) for r in grants(events, small, block_seconds=block_seconds).collect()}
    level, wanted = small.full, set()
    for second in range(60):
        level = min(small.full, level + (2 * small.gain if second else 0))
        take = min(2000 + 37 * second, level // small.parts)
        level -= take * small.parts
        wanted.add((2 * second, take, level))
    assert found == wanted and any(take < 2000 + 37 * s // 2 for s, take, _ in found)
    assert grants(events, bucket, block_seconds=block_seconds).filter("granted < requested").isEmpty()


@pytest.mark.parametrize("block_seconds", [50, 100, 10**6])
def test_late_events_meet_the_carried_bucket_as_it_is(spark, block_seconds):
    initial = spark.createDataFrame([(0, 0, 1000)], "fleet_id long, level long, second long")
    start = datetime(1970, 1, 1, tzinfo=timezone.utc)
    events = [(0, start + timedelta(seconds=s), s) for s in (0, 40, 45, 90, 130, 170, 300)]
    table = written(grants(frame(spark, events), TokenBucket(3, 1, 10), initial, block_seconds), shared_dir(spark, "late"))
    assert table.agg(F.sum("granted")).first()[0] == 0
    left = carried_over(table, initial).first()
    assert (left.level, left.second) == (0, 1000)


@pytest.mark.parametrize("block_seconds", [30, 10**6])
def test_overlapping_batches_equal_a_clock_that_never_runs_back(spark, block_seconds):
    bucket, state, initial = TokenBucket(5, 1, 4, idle_seconds=500), {}, None
    for batch in range(3):
        events = random_events(batch, 150, 120, first=1000 * batch)
        table = written(grants(frame(spark, events), bucket, initial, block_seconds), shared_dir(spark, "overlap"))
        counts, wanted = {}, {}
        for fleet, moment, _ in events:
            key = (fleet, int(moment.timestamp()))
            counts[key] = counts.get(key, 0) + 1
        for fleet, second in sorted(counts):
            level, last = state.get(fleet, (bucket.full, second))
            gap = max(0, second - last)
            level = bucket.full if gap > bucket.idle_seconds else min(bucket.full, level + gap * bucket.gain)
            take = min(counts[fleet, second], level // bucket.parts)
            state[fleet] = (level - take * bucket.parts, max(last, second))
            wanted[fleet, second] = take
        assert {(r.fleet_id, r.second): r.granted for r in table.collect()} == wanted
        initial = written(carried_over(table, initial), shared_dir(spark, "levels"))
        assert {r.fleet_id: (r.level, r.second) for r in initial.collect()} == state


def test_state_store_form(spark, tmp_path):
    for key, value in STATE_STORE_CONF.items():
        spark.conf.set(key, value)
    bucket = TokenBucket(3, 1, 8)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    frames = [random_events(1, 100, 50), random_events(2, 100, 50, first=500)]
    frames[1] = [(f, m + timedelta(seconds=60), i) for f, m, i in frames[1]]
    for number, events in enumerate(frames):
        frame(spark, events).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("fleet_id long, ingested_at timestamp, id long")
        (
            stream_grants(stream.parquet(source), bucket)
            .writeStream.outputMode("update")
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/b={n}"))
            .option("checkpointLocation", str(tmp_path / "checkpoint"))
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    total = spark.read.parquet(out).agg(F.sum("granted"), F.sum("requested")).first()
    assert tuple(total) == (len(sequential(frames[0] + frames[1], bucket)), 200)
