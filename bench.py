"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Each query runs twice to warm up
and then three times in full (every result row is produced, into the no-op sink); the median
counts. Jobs that write tables run once to warm up and once to count.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from roadledger.plans.queries import QUERIES  # noqa: E402
from roadledger.session import build_session  # noqa: E402

HEADLINE = (
    "hourly_vehicle_stats",
    "hourly_rollup",
    "fleet_summary",
    "scenario_counts",
    "scenario_share",
    "scenario_events_page",
    "latest_event_per_vehicle",
    "low_battery_vehicles",
    "overspeed_new_alerts",
    "battery_bands",
    "lag_histogram",
    "latency_report",
    "valid_events",
    "quarantine_reasons",
    "rate_limited",
    "rollup_upsert",
    "event_store",
    "stream_ingest",
    "stream_rollup",
    "stream_latest",
)
ONCE = ("rollup_upsert", "event_store", "stream_ingest", "stream_rollup", "stream_latest")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus),
        conf={
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="roadledger-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    seconds = {}
    for name in HEADLINE:
        for _ in range(1 if name in ONCE else 2):
            run(name)
        rounds = 1 if name in ONCE else 3
        seconds[name] = round(statistics.median(run(name) for _ in range(rounds)), 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "events": events,
                "ingest_events_per_second": round(events / seconds["stream_ingest"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
