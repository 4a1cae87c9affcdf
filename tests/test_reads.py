"""Analytic reads: one fleet against all fleets, paging, empty input, argument checks, reports."""

import json
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadledger.operators import (
    alerts, filters, fleet, hourly, labels, latest, paging, reports,
)
from roadledger.plans.queries import QUERIES
from roadledger.sources import fixtures as fx


@pytest.fixture(scope="module")
def events(spark, data_dir):
    return fx.vehicle_events(spark, data_dir)


def rows(df):
    return sorted(df.collect(), key=str)


def test_one_fleet_is_a_part_of_all_fleets(events):
    for operator in (
        labels.label_counts, latest.latest_events, latest.low_battery_vehicles,
        fleet.battery_bands, fleet.vehicle_count,
        lambda e, f=None: fleet.fleet_summary(e, f, fx.AS_OF),
        lambda e, f=None: hourly.hourly_stats(e, f, hours=None),
        lambda e, f=None: latest.latest_overspeed(e, f, 150, fx.LOOKBACK_MINUTES, fx.AS_OF),
        lambda e, f=None: paging.label_total(e, "low_battery", f),
        lambda e, f=None: paging.label_page(e, "low_battery", f, limit=4, offset=2),
    ):
        everything = operator(events)
        one = operator(events, 3)
        assert rows(everything.filter("fleet_id = 3")) == rows(one.select(*everything.columns))


def test_unknown_fleet(events):
    summary = fleet.fleet_summary(events, 77, fx.AS_OF).collect()
    assert len(summary) == 1
    assert tuple(summary[0])[:5] == (77, 0, 0, None, 0)
    assert labels.label_counts(events, 77).collect() == []
    assert paging.label_total(events, "low_battery", 77).first().total == 0


def test_counts_come_most_frequent_first(events):
    counts = [r.event_count for r in labels.label_counts(events, 2).collect()]
    assert counts == sorted(counts, reverse=True)
    summary = labels.label_map(labels.label_counts(events, 2)).first().summary
    assert sorted(summary.values(), reverse=True) == counts


def test_pages_join_up(events):
    whole = paging.label_page(events, "hard_brake", 1, limit=500).collect()
    assert whole == sorted(whole, key=lambda r: (r.recorded_at, r.event_id), reverse=True)
    pages, last = [], None
    for offset in range(0, len(whole) + 5, 5):
        page = paging.label_page(events, "hard_brake", 1, limit=5, offset=offset).collect()
        by_key = paging.label_page(events, "hard_brake", 1, limit=5, before=last).collect()
        assert page == by_key
        pages += page
        if not page:
            break
        last = (page[-1].recorded_at, page[-1].event_id)
    assert pages == whole


def test_page_envelope(events):
    envelope = paging.page_envelope(events, "hard_brake", limit=3, offset=1)
    for row in envelope.collect():
        page = paging.label_page(events, "hard_brake", row.fleet_id, limit=3, offset=1).collect()
        assert [r.event_id for r in row.results] == [r.event_id for r in page]
        assert (row.scenario, row.limit, row.offset) == ("hard_brake", 3, 1)
    single = paging.page_envelope(events, "hard_brake", 77, limit=3).first()
    assert single.total == 0 and single.results == []


def test_arguments_are_checked(events):
    for call in (
        lambda: latest.low_battery_vehicles(events, threshold=200),
        lambda: latest.low_battery_vehicles(events, threshold=0),
        lambda: hourly.hourly_stats(events, hours=169),
        lambda: paging.page_envelope(events, "hard_brake", limit=0),
        lambda: paging.label_page(events, "hard_brake", limit=0),
        lambda: paging.label_page(events, "hard_brake", offset=-1),
        lambda: paging.label_page(events, "no_such_label"),
    ):
        with pytest.raises(ValueError):
            call()


def test_page_limit_is_the_callers(events):
    whole = paging.label_page(events, "low_battery", limit=10**6).collect()
    assert len(whole) == labels.label_counts(events).filter("scenario_label = 'low_battery'").agg({"event_count": "sum"}).first()[0]
    for limit, offset in ((2000, 0), (3, 998), (700, 600)):
        page = paging.label_page(events, "low_battery", limit=limit, offset=offset).collect()
        wanted = []
        for fleet in {r.fleet_id for r in whole}:
            rows = sorted((r for r in whole if r.fleet_id == fleet), key=lambda r: (r.recorded_at, r.event_id), reverse=True)
            wanted += rows[offset : offset + limit]
        assert sorted(page) == sorted(wanted)


def test_one_vehicle_is_sorted(events):
    stats = hourly.hourly_stats(events, 1, 1, hours=None).collect()
    hours = [r.hour_bucket for r in stats]
    assert hours and hours == sorted(hours, reverse=True)
    chart = [r.hour_bucket for r in hourly.chart_series(hourly.hourly_stats(events, 1, 1, None)).collect()]
    assert chart == sorted(hours)
    stored = hourly.read_rollup(hourly.rollup_rows(events), 1, 1, fx.AS_OF - timedelta(days=9))
    assert [r.hour_bucket for r in stored.collect()] == [
        h for h in hours if h >= (fx.AS_OF - timedelta(days=9)).replace(tzinfo=None)
    ]


def test_recharged_vehicle_still_shows(spark):
    rows_ = [(1, 0, 7, "2024-01-01 00:00:00", 10), (2, 0, 7, "2024-01-01 01:00:00", 90)]
    low = spark.createDataFrame(
        rows_, "id int, fleet_id int, vehicle_id int, recorded_at string, battery_level int"
    ).selectExpr("*", "1.0 AS latitude", "2.0 AS longitude")
    low = low.withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    found = latest.low_battery_vehicles(low).collect()
    assert [r.battery_level for r in found] == [10]


def test_ties_go_to_the_larger_id(spark):
    rows_ = [(i, 0, 7, 50) for i in (3, 9, 5)]
    tied = spark.createDataFrame(rows_, "id int, fleet_id int, vehicle_id int, battery_level int")
    tied = tied.selectExpr("*", "TIMESTAMP '2024-01-01' AS recorded_at")
    assert latest.newest_per_vehicle(tied).first().id == 9


def test_alerts(spark, data_dir, events):
    known = fx.alert_table(spark, data_dir)
    found = alerts.new_overspeed_alerts(
        events, known, lookback_minutes=fx.LOOKBACK_MINUTES, as_of=fx.AS_OF
    )
    again = alerts.new_overspeed_alerts(
        events, known.unionByName(found), lookback_minutes=fx.LOOKBACK_MINUTES, as_of=fx.AS_OF
    )
    assert found.count() == 1 and again.count() == 0
    payload = json.loads(found.first().payload)
    assert list(payload) == ["speed", "lat", "lon"] and payload["speed"] > 200
    # An alert older than the lookback no longer counts.
    old = known.withColumn("triggered_at", F.lit(fx.AS_OF - timedelta(days=8)))
    fresh = alerts.new_overspeed_alerts(
        events, old, lookback_minutes=fx.LOOKBACK_MINUTES, as_of=fx.AS_OF
    )
    assert fresh.count() == 2


def test_containment(events):
    wanted = filters.has_all_labels(["hard_brake", "low_battery"])
    found = events.filter(wanted).collect()
    assert found and all({"hard_brake", "low_battery"} <= set(r.scenarios) for r in found)
    assert events.filter(filters.has_all_labels([])).count() == events.count()
    assert filters.tagged(events).filter(F.size("scenarios") == 0).count() == 0


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
@pytest.mark.parametrize("shape", ["spread", "equal", "few", "single"])
def test_percentiles_are_exact(spark, shape, broadcast_rows, monkeypatch):
    monkeypatch.setattr(reports, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(1)
    values = {
        "spread": [rng.lognormvariate(0, 3) for _ in range(5000)],
        "equal": [2.5] * 1000 + [rng.random() for _ in range(500)],
        "few": [float(rng.randrange(4)) for _ in range(999)],
        "single": [7.0],
    }[shape]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", 3.0)], "k string, v double")
    fractions = (0.0, 0.01, 0.5, 0.95, 0.99, 1.0)
    # A coarse sketch must not matter.
    found = reports.exact_percentiles(df, "v", ["k"], fractions, accuracy=20).collect()
    got = {(r.k, r.fraction): r.percentile for r in found}
    assert len(got) == 2 * len(fractions)
    for p in fractions:
        assert got["a", p] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12)
        assert got["b", p] == pytest.approx(1 + 2 * p)
    overall = reports.exact_percentiles(df, "v", (), (0.5,)).first().percentile
    assert overall == pytest.approx(np.percentile(values + [1.0, 3.0], 50))


def test_percentiles_sort_no_more_than_the_bound(spark):
    """Two million different values, a third of all rows equal, and a sketch that is far off."""
    rows = spark.range(3_000_000, numPartitions=8).selectExpr("1 AS k", "IF(id < 2000000, pow(id, 3), 5000.5D) AS v")
    values = np.sort(np.concatenate([np.arange(2_000_000, dtype=float) ** 3, np.full(1_000_000, 5000.5)]))
    fractions = (0.1, 0.5, 0.999)
    found = reports.exact_percentiles(rows, "v", ["k"], fractions, accuracy=30, bound=2000)
    for row in found.collect():
        assert row.percentile == pytest.approx(np.percentile(values, 100 * row.fraction), rel=1e-12)
    targets, inside = reports.narrowed(rows.selectExpr("k", "v AS value"), ["k"], fractions, 30, 2000)
    assert targets.filter("fraction = 0.1 AND lo = hi").count() > 0
    counts = [r["count"] for r in inside.groupBy("k", "start").count().collect()]
    assert counts and max(counts) <= 2000


@pytest.mark.parametrize("rows_per_slice", [10**6, 40, 3])
def test_deep_pages_sort_only_their_slices(spark, rows_per_slice):
    """Fleet 0 has 40 rows in one second and 30 at one time; fleet 1 is too short for the page."""
    rows = [(k, k // 3000, 7 * k) for k in range(3100)]
    rows += [(9000 + k, 0, 10_000 + k / 50) for k in range(40)] + [(8000 + k, 0, 12_345.5) for k in range(30)]
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    events = spark.createDataFrame(
        [(k, f, start + timedelta(seconds=s)) for k, f, s in rows], "id long, fleet_id long, recorded_at timestamp"
    ).withColumn("event_date", F.to_date("recorded_at"))
    newest = sorted(((s, k) for k, f, s in rows if f == 0), reverse=True)
    for limit, offset in ((50, 1200), (10, 1560), (400, 1300), (5, 3065), (10, 5000)):
        page = paging.deep_page(events, limit, offset, rows_per_slice)
        assert {r.id for r in page.collect()} == {k for _, k in newest[offset : offset + limit]}
    page = paging.deep_page(events, 10, 1200, rows_per_slice)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual" in plan or "recorded_at#" in plan and ">=" in plan


def test_one_fleets_deep_page_is_in_order(events):
    deep = paging.label_page(events, "low_battery", 2, limit=8, offset=5, group_limit=6)
    top = paging.label_page(events, "low_battery", 2, limit=8, offset=5)
    assert [r.event_id for r in deep.collect()] == [r.event_id for r in top.collect()] and deep.count() == 8


def test_summary_from_the_rollup(events):
    rollup = hourly.rollup_rows(events)
    for as_of in (fx.AS_OF, fx.AS_OF - timedelta(days=9, minutes=17)):
        for one in (None, 2, 77):
            wanted = fleet.fleet_summary(events, one, as_of)
            assert rows(fleet.summary_from_rollup(rollup, events, one, as_of)) == rows(wanted)
            # A rollup that lacks the last hours' vehicles.
            old = rollup.filter(F.col("hour_bucket") < F.lit(as_of - timedelta(hours=2)))
            seen = events.filter(F.col("recorded_at") < F.lit(as_of))
            known = seen.filter((F.col("recorded_at") < F.date_trunc("hour", F.lit(as_of - timedelta(hours=2)))) | (F.col("recorded_at") >= F.lit(as_of - timedelta(hours=1))))
            assert rows(fleet.summary_from_rollup(old, seen, one, as_of)) == rows(fleet.fleet_summary(known, one, as_of))


def test_sketches_of_dates_can_be_merged(spark):
    rollup = spark.range(200_000).selectExpr("id % 2 AS fleet_id", "id % 50000 AS vehicle_id", "date_add(DATE '2024-01-01', CAST(id % 30 AS INT)) AS bucket_date")
    found = fleet.sketched_vehicle_count(fleet.vehicle_sketches(rollup)).collect()
    assert len(found) == 2 and all(abs(r.vehicle_count - 25_000) < 1500 for r in found)


def test_histogram_and_latency(spark):
    log = spark.createDataFrame(
        [(0.002, 201), (0.2, 500), (2.0, -1), (None, 200)], "duration double, status int"
    ).withColumn("requested_at", F.expr("TIMESTAMP '2024-01-01' + make_interval(0,0,0,0,0,0,duration)"))
    bounds = reports.histogram(log, F.col("duration"), reports.INGEST_BOUNDS).collect()
    assert [r.event_count for r in bounds] == [0, 1, 1, 1, 1, 1, 2, 2, 2, 3]
    report = reports.latency_report(log).first()
    assert (report.requests, report.errors, report.p50) == (4, 2, 0.2)


def test_plans_have_no_products_and_limit_groups_early(events):
    page = paging.label_page(events, "hard_brake", limit=5)._jdf.queryExecution()
    assert page.executedPlan().toString().count("WindowGroupLimit") == 2
    summary = fleet.fleet_summary(events, as_of=fx.AS_OF)._jdf.queryExecution()
    assert "Expand" not in summary.executedPlan().toString()
    top = paging.label_page(events, "hard_brake", 1, limit=5)._jdf.queryExecution()
    assert "TakeOrderedAndProject" in top.executedPlan().toString()


def test_registered_deep_page_reaches_rank_1200(spark, tmp_path):
    """1300 low batteries in one fleet, 20 in another: rows 13 to 1200 of each, by the rank index."""
    spark.range(1320).selectExpr(
        "id AS event_id", "CASE WHEN id < 1300 THEN 5L ELSE 6L END AS user_id",
        "timestamp_seconds(1704067200 + id * 600) AS ts", "'view' AS event_type", "CAST(50 AS DOUBLE) AS value", "'{\"k\": 3}' AS props",
    ).write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["scenario_page_deep"](spark, str(tmp_path)).select("fleet_id", "event_id").collect()
    assert {r.event_id for r in found if r.fleet_id == 0} == set(range(100, 1288))
    assert {r.event_id for r in found if r.fleet_id == 1} == set(range(1300, 1308))
