"""Known counts of the derived vehicle events."""

import os

import pytest
from pyspark.sql import functions as F

from roadledger.operators import admission, alerts, hourly, labels, latest, reports
from roadledger.sources import fixtures as fx

ROOT = "/root/testdata"
KNOWN = {
    "sf0.001": {
        "labels": (133, 135, 136, 148, 75), "hours": 951, "bands": (148, 160, 692),
        "overspeed": 2, "new": 1, "admitted": 1000, "lags": (12, 12, 24, 72, 131, 351, 681, 1000),
    },
    "sf0.01": {
        "labels": (1355, 1350, 1316, 1495, 774), "hours": 9567, "bands": (1495, 1477, 7028),
        "overspeed": 33, "new": 30, "admitted": 6098,
        "lags": (112, 112, 224, 672, 1231, 3451, 6781, 10000),
    },
    "sf0.1": {
        "labels": (13511, 13489, 13360, 15241, 7720), "hours": 95583,
        "bands": (15241, 15091, 69668), "overspeed": 376, "new": 270, "admitted": 6340,
        "lags": (1112, 1112, 2224, 6672, 12231, 34451, 67781, 100000),
    },
}


@pytest.mark.parametrize("scale", KNOWN)
def test_known_counts(spark, scale):
    data_dir, known = f"{ROOT}/{scale}", KNOWN[scale]
    if not os.path.isdir(data_dir):
        pytest.skip("no data at this scale")
    events = fx.vehicle_events(spark, data_dir)
    counted = labels.label_counts(events).groupBy("scenario_label").agg(F.sum("event_count"))
    found = {row[0]: row[1] for row in counted.collect()}
    order = ("hard_brake", "rapid_acceleration", "over_speeding", "low_battery", "risky_weather_event")
    assert tuple(found[label] for label in order) == known["labels"]
    assert hourly.rollup_rows(events).count() == known["hours"]
    week = {"lookback_minutes": fx.LOOKBACK_MINUTES, "as_of": fx.AS_OF}
    assert latest.latest_overspeed(events, **week).count() == known["overspeed"]
    stored = fx.alert_table(spark, data_dir)
    assert alerts.new_overspeed_alerts(events, stored, **week).count() == known["new"]
    lags = reports.histogram(events, reports.ingest_lag(), reports.TASK_BOUNDS).collect()
    assert tuple(row.event_count for row in lags) == known["lags"]
    bucket = admission.TokenBucket(3, 1, 2048, idle_seconds=10**9)
    assert admission.grants(events, bucket).agg(F.sum("granted")).first()[0] == known["admitted"]
