"""Checking SQL: every registered query written again over the raw test tables.

Each statement starts from the same mapping of the generic ``events`` table to vehicle events.
"""

from __future__ import annotations

EVENTS = """
raw AS (
  SELECT event_id AS id, user_id % 5 AS fleet_id, user_id AS vehicle_id,
    CAST(value AS DECIMAL(6,2)) AS speed,
    CASE WHEN event_id % 211 = 0 THEN CAST(0 AS DECIMAL(9,6))
      ELSE CAST(CAST(34000 + event_id % 2000 AS DOUBLE) / 1000 AS DECIMAL(9,6)) END AS latitude,
    CASE WHEN event_id % 211 = 0 THEN CAST(0 AS DECIMAL(9,6))
      ELSE CAST(CAST(135000 + event_id % 5000 AS DOUBLE) / 1000 AS DECIMAL(9,6)) END AS longitude,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS battery_level,
    ts AS recorded_at,
    ts + INTERVAL '1' SECOND * (event_id % 90) AS ingested_at,
    CASE WHEN event_id % 10 = 0 THEN NULL
      ELSE CAST(CAST((event_id * 7919) % 20001 - 10000 AS DOUBLE) / 1000 AS DECIMAL(7,3))
      END AS acceleration,
    CASE event_id % 7 WHEN 1 THEN 'clear' WHEN 2 THEN 'rain' WHEN 3 THEN 'SNOW' WHEN 4 THEN 'Fog'
      WHEN 5 THEN 'wind' WHEN 6 THEN 'fog' END AS weather,
    CASE event_id % 3 WHEN 1 THEN TRUE WHEN 2 THEN FALSE END AS engine_on,
    CAST(CAST(value AS DECIMAL(6,2)) * 100 AS BIGINT) AS cents,
    event_type, value / 1000 AS duration, event_id % 3 = 0 AS hit
  FROM events
),
ev AS (
  SELECT *,
    concat_ws(',',
      CASE WHEN acceleration < -7 THEN 'hard_brake' END,
      CASE WHEN acceleration > 7 THEN 'rapid_acceleration' END,
      CASE WHEN speed > 100 THEN 'over_speeding' END,
      CASE WHEN battery_level < 15 THEN 'low_battery' END,
      CASE WHEN acceleration < -7 AND lower(weather) IN ('rain', 'snow', 'fog')
        THEN 'risky_weather_event' END) AS scenarios,
    date_trunc('hour', recorded_at) AS hour_bucket,
    strftime(recorded_at, '%Y-%m') AS event_month
  FROM raw
),
lab AS (
  SELECT id, fleet_id, recorded_at, 'hard_brake' AS scenario_label FROM ev WHERE acceleration < -7
  UNION ALL
  SELECT id, fleet_id, recorded_at, 'rapid_acceleration' FROM ev WHERE acceleration > 7
  UNION ALL
  SELECT id, fleet_id, recorded_at, 'over_speeding' FROM ev WHERE speed > 100
  UNION ALL
  SELECT id, fleet_id, recorded_at, 'low_battery' FROM ev WHERE battery_level < 15
  UNION ALL
  SELECT id, fleet_id, recorded_at, 'risky_weather_event' FROM ev
  WHERE acceleration < -7 AND lower(weather) IN ('rain', 'snow', 'fog')
),
vehicles AS (
  SELECT user_id AS id, user_id % 5 AS fleet_id, concat('VIN-', user_id) AS vin
  FROM (SELECT DISTINCT user_id FROM events) AS u
)"""

# The exact mean of n speeds in cents, rounded half up, as a double in units.
MEAN = "CAST((2 * sum(cents) + count(cents)) // (2 * count(cents)) AS DOUBLE) / 100"
HOURLY = f"""
  SELECT fleet_id, vehicle_id, hour_bucket, {MEAN} AS avg_speed,
    CAST(max(speed) AS DOUBLE) AS max_speed,
    CAST(min(battery_level) AS BIGINT) AS min_battery,
    count(*) AS event_count
  FROM ev GROUP BY fleet_id, vehicle_id, hour_bucket"""

POSITION = "CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude"



def landing(clock: str) -> str:
    """Raw text rows with their planted defects, one flag per reason, checked at ``clock``."""
    return f"""
landing AS (
  SELECT ev.*,
    CASE WHEN id % 43 = 1 THEN 90.5 WHEN id % 43 = 2 THEN NULL ELSE latitude END AS lat,
    CASE WHEN id % 47 = 1 THEN -180.000001 WHEN id % 47 = 2 THEN 135.1234567
      ELSE longitude END AS lon,
    CASE WHEN id % 59 = 1 THEN NULL
      WHEN id % 59 = 2 THEN TIMESTAMP '2024-01-31 00:05:01'
      WHEN id % 59 = 3 THEN TIMESTAMP '2024-01-31 00:05:00' ELSE recorded_at END AS sent_at
  FROM ev
),
flagged AS (
  SELECT landing.*,
    id % 43 = 2 AS missing_latitude,
    id % 41 = 4 AS speed_type,
    id % 41 IN (1, 2) OR (id % 41 NOT IN (3, 4) AND (speed > 500 OR speed < 0)) AS speed_range,
    id % 41 = 3 AS speed_scale,
    id % 43 = 1 AS lat_range,
    id % 47 = 1 AS lon_range,
    id % 47 = 2 AS lon_scale,
    id % 53 = 2 AS battery_type,
    id % 53 = 1 AS battery_range,
    coalesce(lat = 0 AND lon = 0, FALSE) AS zero_position,
    id % 59 = 1 AS time_naive,
    coalesce(sent_at > {clock} + INTERVAL '300' SECOND, FALSE) AS time_future,
    id % 61 = 1 AS weather_length
  FROM landing
),
reasoned AS (
  SELECT flagged.*, concat_ws(',',
    CASE WHEN missing_latitude THEN 'missing_latitude' END,
    CASE WHEN speed_type THEN 'speed_type' END,
    CASE WHEN speed_range THEN 'speed_range' END,
    CASE WHEN speed_scale THEN 'speed_scale' END,
    CASE WHEN lat_range THEN 'lat_range' END,
    CASE WHEN lon_range THEN 'lon_range' END,
    CASE WHEN lon_scale THEN 'lon_scale' END,
    CASE WHEN battery_type THEN 'battery_type' END,
    CASE WHEN battery_range THEN 'battery_range' END,
    CASE WHEN zero_position THEN 'zero_position' END,
    CASE WHEN time_naive THEN 'time_naive' END,
    CASE WHEN time_future THEN 'time_future' END,
    CASE WHEN weather_length THEN 'weather_length' END) AS reasons
  FROM flagged
),
valid AS (
  SELECT * REPLACE (sent_at AS recorded_at) FROM reasoned WHERE reasons = ''
)"""

REASONS = (
    "missing_latitude speed_type speed_range speed_scale lat_range lon_range lon_scale "
    "battery_type battery_range zero_position time_naive time_future weather_length"
).split()


def bucket(source: str, idle: int) -> str:
    """Token bucket over ``source``: capacity 3, one token per 2048 s, counted in 1/2048 token."""
    refill = (
        f"CASE WHEN s.second - b.second > {idle} THEN 6144 "
        "ELSE least(6144, b.level + s.second - b.second) END"
    )
    return f"""
seconds AS (
  SELECT *, row_number() OVER (PARTITION BY fleet_id ORDER BY second) AS n
  FROM (SELECT fleet_id, epoch_us(ingested_at) // 1000000 AS second, count(*) AS requested
        FROM {source} GROUP BY 1, 2) AS c
),
buckets AS (
  SELECT fleet_id, n, second, requested, least(requested, 3) AS granted,
    6144 - 2048 * least(requested, 3) AS level
  FROM seconds WHERE n = 1
  UNION ALL
  SELECT s.fleet_id, s.n, s.second, s.requested,
    least(s.requested, ({refill}) // 2048),
    ({refill}) - 2048 * least(s.requested, ({refill}) // 2048)
  FROM buckets AS b JOIN seconds AS s ON s.fleet_id = b.fleet_id AND s.n = b.n + 1
),
ranked AS (
  SELECT e.*, b.granted, row_number() OVER (
    PARTITION BY e.fleet_id, b.second ORDER BY e.ingested_at, e.id) AS arrival
  FROM {source} AS e JOIN buckets AS b
    ON b.fleet_id = e.fleet_id AND b.second = epoch_us(e.ingested_at) // 1000000
)"""


def carried_bucket(idle: int) -> str:
    """The same bucket over two batches that overlap in time; its clock never runs back."""
    refill = (
        f"CASE WHEN s.clock - b.clock > {idle} THEN 6144 "
        "ELSE least(6144, b.level + s.clock - b.clock) END"
    )
    return f"""
batched AS (
  SELECT fleet_id, epoch_us(ingested_at) // 1000000 AS second,
    CASE WHEN ingested_at < TIMESTAMP '2024-01-15 00:00:00'
      OR (ingested_at < TIMESTAMP '2024-01-20 00:00:00' AND id % 2 = 1) THEN 1 ELSE 2 END AS batch
  FROM ev
),
seconds AS (
  SELECT *, row_number() OVER (PARTITION BY fleet_id ORDER BY batch, second) AS n,
    max(second) OVER (PARTITION BY fleet_id ORDER BY batch, second ROWS UNBOUNDED PRECEDING) AS clock
  FROM (SELECT fleet_id, batch, second, count(*) AS requested FROM batched GROUP BY 1, 2, 3) AS c
),
buckets AS (
  SELECT fleet_id, batch, n, second, clock, requested, least(requested, 3) AS granted,
    6144 - 2048 * least(requested, 3) AS level
  FROM seconds WHERE n = 1
  UNION ALL
  SELECT s.fleet_id, s.batch, s.n, s.second, s.clock, s.requested,
    least(s.requested, ({refill}) // 2048),
    ({refill}) - 2048 * least(s.requested, ({refill}) // 2048)
  FROM buckets AS b JOIN seconds AS s ON s.fleet_id = b.fleet_id AND s.n = b.n + 1
)"""


def over_events(select: str, *ctes: str) -> str:
    return "WITH " + ",".join([EVENTS, *ctes]) + "\n" + select


def recursive(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join([EVENTS, *ctes]) + "\n" + select


def newest(columns: str, condition: str = "TRUE") -> str:
    return over_events(f"""
SELECT {columns} FROM (
  SELECT *, row_number() OVER (
    PARTITION BY fleet_id, vehicle_id ORDER BY recorded_at DESC, id DESC) AS n
  FROM ev WHERE {condition}) AS t
WHERE n = 1""")


def open_vehicle(kind: str) -> str:
    """Vehicles with an open alert: even ids not divisible by four, alerted a day before."""
    return f"vehicle_id % 2 = 0 AND vehicle_id % 4 <> 0 AND '{kind}' = 'OVERSPEED'"


def _counts(condition: str = "TRUE") -> str:
    return (
        "SELECT fleet_id, scenario_label, count(*) AS event_count FROM lab "
        f"WHERE {condition} GROUP BY 1, 2"
    )


def statements() -> dict[str, str]:
    as_of = "TIMESTAMP '2024-01-31 00:00:00'"
    at_once = landing(as_of)
    on_arrival = landing("ingested_at")
    week_ago = "TIMESTAMP '2024-01-24 00:00:00'"
    hourly = over_events(HOURLY)
    latest = newest(
        f"fleet_id, vehicle_id, CAST(speed AS DOUBLE) AS speed, {POSITION}, "
        "battery_level, recorded_at"
    )
    alert_payload = (
        "concat('{\"speed\":', CAST(speed AS VARCHAR), ',\"lat\":', CAST(latitude AS VARCHAR), "
        "',\"lon\":', CAST(longitude AS VARCHAR), '}')"
    )
    sql: dict[str, str] = {}

    sql["detect_scenarios"] = over_events("SELECT id, fleet_id, scenarios FROM ev")
    sql["scenario_counts"] = over_events(_counts())
    sql["scenario_counts_in_range"] = over_events(
        _counts(
            "recorded_at >= TIMESTAMP '2024-01-10 00:00:00' "
            "AND recorded_at < TIMESTAMP '2024-01-20 12:00:00'"
        )
    )
    sql["scenario_share"] = over_events(f"""
SELECT fleet_id, scenario_label, replace(scenario_label, '_', ' ') AS label_text, event_count,
  CAST(total AS BIGINT) AS total,
  CAST((2000 * event_count + total) // (2 * total) AS DOUBLE) / 10 AS percent
FROM (SELECT *, sum(event_count) OVER (PARTITION BY fleet_id) AS total
      FROM ({_counts()}) AS c) AS t""")
    sql["label_descriptions"] = over_events("""
SELECT d.scenario_label, replace(d.scenario_label, '_', ' ') AS label_text, d.description,
  count(lab.id) AS event_count
FROM (VALUES ('hard_brake', 'Deceleration below -7 m/s².'),
  ('rapid_acceleration', 'Acceleration above +7 m/s².'),
  ('over_speeding', 'Speed exceeds 100 km/h.'),
  ('low_battery', 'Battery level below 15%.'),
  ('risky_weather_event', 'Hard brake during rain, snow, or fog.')
) AS d(scenario_label, description)
LEFT JOIN lab ON lab.scenario_label = d.scenario_label GROUP BY 1, 2, 3""")
    sql["scenario_events_page"] = over_events("""
SELECT fleet_id, id AS event_id, vehicle_id, recorded_at, CAST(speed AS DOUBLE) AS speed,
  battery_level, CAST(acceleration AS DOUBLE) AS acceleration, weather, scenarios
FROM (SELECT *, row_number() OVER (
    PARTITION BY fleet_id ORDER BY recorded_at DESC, id DESC) AS n
  FROM ev WHERE acceleration < -7) AS t
WHERE n > 5 AND n <= 25""")
    def low_batteries(keep: str, condition: str) -> str:
        return over_events(f"""
SELECT fleet_id, id AS event_id, vehicle_id, recorded_at, CAST(speed AS DOUBLE) AS speed,
  battery_level, CAST(acceleration AS DOUBLE) AS acceleration, weather, scenarios
FROM (SELECT *, row_number() OVER (
    PARTITION BY fleet_id ORDER BY recorded_at DESC, id DESC) AS n
  FROM ev WHERE battery_level < 15 AND {condition}) AS t
WHERE {keep}""")

    sql["scenario_page_deep"] = low_batteries("n > 12 AND n <= 1200", "TRUE")
    sql["one_fleet_page"] = low_batteries("n > 10 AND n <= 1010", "fleet_id = 2")
    sql["scenario_page_envelope"] = over_events("""
SELECT fleet_id, 'hard_brake' AS scenario, max(total) AS total, CAST(30 AS BIGINT) AS "limit", CAST(4 AS BIGINT) AS "offset",
  coalesce(string_agg(CASE WHEN n > 4 AND n <= 34 THEN CAST(id AS VARCHAR) END, ',' ORDER BY n), '') AS results
FROM (SELECT fleet_id, id, row_number() OVER (PARTITION BY fleet_id ORDER BY recorded_at DESC, id DESC) AS n,
    count(*) OVER (PARTITION BY fleet_id) AS total
  FROM ev WHERE acceleration < -7) AS t
GROUP BY fleet_id""")
    sql["tagged_events"] = over_events("SELECT id, fleet_id, scenarios FROM ev WHERE scenarios <> ''")
    sql["one_hour"] = over_events("""
SELECT id, fleet_id, vehicle_id, recorded_at FROM ev
WHERE recorded_at >= TIMESTAMP '2024-01-15 07:00:00' AND recorded_at < TIMESTAMP '2024-01-15 08:00:00'""")
    sql["one_vehicle_hours"] = over_events(
        f"SELECT fleet_id, vehicle_id, hour_bucket, avg_speed, max_speed, event_count FROM ({HOURLY}) AS h "
        "WHERE fleet_id = 2 AND vehicle_id = 7"
    )
    sql["scenario_events_total"] = over_events(
        "SELECT fleet_id, count(*) AS total FROM ev WHERE acceleration < -7 GROUP BY fleet_id"
    )
    sql["containment"] = over_events("""
SELECT id, fleet_id, recorded_at, scenarios FROM ev
WHERE acceleration < -7 AND lower(weather) IN ('rain', 'snow', 'fog') AND speed > 100""")

    stats = "fleet_id, vehicle_id, hour_bucket, avg_speed, max_speed, event_count"
    sql["hourly_vehicle_stats"] = over_events(f"SELECT {stats} FROM ({HOURLY}) AS h")
    sql["hourly_vehicle_stats_lookback"] = over_events(f"""
SELECT fleet_id, vehicle_id, hour_bucket, {MEAN} AS avg_speed,
  CAST(max(speed) AS DOUBLE) AS max_speed, count(*) AS event_count
FROM ev WHERE recorded_at >= TIMESTAMP '2024-01-23 23:30:00'
GROUP BY fleet_id, vehicle_id, hour_bucket""")
    sql["hourly_chart"] = sql["hourly_vehicle_stats"]
    sql["hourly_rollup"] = hourly
    sql["rollup_scan"] = over_events(f"""
SELECT *, {as_of} AS computed_at FROM ({HOURLY}) AS h
WHERE hour_bucket >= TIMESTAMP '2024-01-21 00:00:00'""")
    sql["fleet_summary"] = over_events(f"""
SELECT fleet_id, count(DISTINCT vehicle_id) AS total_vehicles,
  count(DISTINCT CASE WHEN recorded_at >= TIMESTAMP '2024-01-30 23:00:00' THEN vehicle_id END)
    AS active_vehicles_last_hour,
  CAST((2 * sum(recent) + count(recent)) // (2 * count(recent)) AS DOUBLE) / 100
    AS avg_speed_last_hour,
  count(DISTINCT CASE WHEN battery_level < 20 THEN vehicle_id END) AS low_battery_count,
  {as_of} AS generated_at
FROM (SELECT *, CASE WHEN recorded_at >= TIMESTAMP '2024-01-30 23:00:00' THEN cents END AS recent
      FROM ev) AS t
GROUP BY fleet_id""")
    sql["fleet_summary_from_rollup"] = sql["fleet_summary"]
    sql["vehicle_count"] = over_events(
        "SELECT fleet_id, count(DISTINCT vehicle_id) AS vehicle_count FROM ev GROUP BY fleet_id"
    )
    sql["battery_bands"] = over_events("""
SELECT fleet_id, CASE WHEN battery_level < 15 THEN 'low' WHEN battery_level < 30 THEN 'mid'
  ELSE 'high' END AS battery_band, count(*) AS event_count
FROM ev GROUP BY 1, 2""")
    sql["latest_event_per_vehicle"] = latest
    sql["low_battery_vehicles"] = newest(
        f"fleet_id, vehicle_id, battery_level, recorded_at AS last_seen, {POSITION}",
        "battery_level < 20",
    )
    overspeed = f"recorded_at >= {week_ago} AND speed > 200"
    sql["overspeed_latest"] = newest(
        f"id, fleet_id, vehicle_id, CAST(speed AS DOUBLE) AS speed, recorded_at, {POSITION}",
        overspeed,
    )
    sql["overspeed_new_alerts"] = newest(
        f"""sha256(concat(fleet_id, '|', vehicle_id, '|OVERSPEED|', id)) AS alert_id,
  fleet_id, vehicle_id, 'OVERSPEED' AS alert_type, 'WARNING' AS severity,
  {alert_payload} AS payload, FALSE AS acknowledged, {as_of} AS triggered_at""",
        f"{overspeed} AND NOT ({open_vehicle('OVERSPEED')})",
    )
    sql["critical_battery_alerts"] = over_events(f"""
SELECT DISTINCT fleet_id, vehicle_id, 'CRITICAL_BATTERY' AS alert_type, 'WARNING' AS severity,
  {as_of} AS triggered_at
FROM ev WHERE recorded_at >= {week_ago} AND battery_level < 10""")
    sql["alert_log"] = over_events(f"""
SELECT fleet_id, id AS vehicle_id, 'OVERSPEED' AS alert_type, id % 4 = 0 AS acknowledged,
  TIMESTAMP '2024-01-30 00:00:00' AS triggered_at FROM vehicles WHERE id % 2 = 0
UNION ALL
SELECT DISTINCT fleet_id, vehicle_id, 'OVERSPEED', FALSE, {as_of} FROM ev
WHERE {overspeed} AND NOT ({open_vehicle('OVERSPEED')})""")

    valid_columns = (
        "id, ingested_at, fleet_id, vehicle_id, CAST(speed AS DOUBLE) AS speed, "
        f"{POSITION}, battery_level, CAST(acceleration AS DOUBLE) AS acceleration, recorded_at, "
        "weather, engine_on, scenarios"
    )
    sql["valid_events"] = over_events(f"SELECT {valid_columns} FROM valid", at_once)
    sql["quarantine_reasons"] = over_events(
        "SELECT reason, row_count FROM (\n"
        + "\nUNION ALL\n".join(
            f"SELECT '{name}' AS reason, count(*) AS row_count FROM flagged WHERE {name}"
            for name in REASONS
        )
        + ") AS r WHERE row_count > 0",
        at_once,
    )
    sql["quarantined_rows"] = over_events(
        "SELECT id, reasons FROM reasoned WHERE reasons <> ''", at_once
    )
    sql["stored_range_violations"] = over_events("""
SELECT * FROM (SELECT id, concat_ws(',',
    CASE WHEN speed < 0 OR speed > 500 THEN 'speed_range' END,
    CASE WHEN battery_level < 0 OR battery_level > 100 THEN 'battery_range' END,
    CASE WHEN latitude = 0 AND longitude = 0 THEN 'zero_position' END) AS reasons
  FROM ev) AS t WHERE reasons <> ''""")
    sql["event_store"] = over_events("""
SELECT event_month, strftime(recorded_at, '%Y-%m-%d') AS event_date, 2 * count(*) AS event_count
FROM ev GROUP BY 1, 2""")
    sql["event_store_compacted"] = over_events("""
SELECT event_month, strftime(recorded_at, '%Y-%m-%d') AS event_date, count(*) AS event_count,
  CAST(sum(id) AS BIGINT) AS ids, CAST(1 AS BIGINT) AS parts,
  CAST(sum(CASE WHEN scenarios = '' THEN 0 ELSE len(string_split(scenarios, ',')) END) AS BIGINT) AS labels,
  CAST(sum(epoch_us(recorded_at) % 1000003) AS BIGINT) AS times
FROM ev GROUP BY 1, 2""")
    key = "concat('00000000-0000-4000-8000-', lpad(CAST({0} AS VARCHAR), 12, '0'))"
    sql["json_landing"] = over_events(f"""
SELECT {key.format('fleet_id')} AS fleet_id, {key.format('vehicle_id')} AS vehicle_id,
  CASE WHEN id % 3 = 2 THEN make_timestamp(epoch_us(recorded_at) // 1000 * 1000) ELSE recorded_at END AS recorded_at,
  CASE WHEN id % 2 = 0 THEN date_trunc('second', ingested_at) END AS arrived_at,
  CAST(speed AS DOUBLE) AS speed, battery_level,
  concat_ws(',', CASE WHEN speed > 100 THEN 'over_speeding' END, CASE WHEN battery_level < 15 THEN 'low_battery' END) AS scenarios
FROM ev WHERE id % 97 <> 1 AND id % 71 <> 1 AND speed BETWEEN 0 AND 500 AND battery_level BETWEEN 0 AND 100
  AND NOT (latitude = 0 AND longitude = 0)""")
    sql["json_landing_reasons"] = over_events("""
SELECT reason, count(*) AS row_count FROM (
  SELECT 'malformed_json' AS reason FROM ev WHERE id % 97 = 1
  UNION ALL SELECT 'fleet_uuid' FROM ev WHERE id % 97 <> 1 AND id % 71 = 1
  UNION ALL SELECT 'speed_range' FROM ev WHERE id % 97 <> 1 AND NOT speed BETWEEN 0 AND 500
  UNION ALL SELECT 'battery_range' FROM ev WHERE id % 97 <> 1 AND NOT battery_level BETWEEN 0 AND 100
  UNION ALL SELECT 'zero_position' FROM ev WHERE id % 97 <> 1 AND latitude = 0 AND longitude = 0) AS t
GROUP BY reason""")
    sql["month_coverage"] = over_events("""
SELECT strftime(m, '%Y-%m') AS event_month, strftime(m, '%Y-%m-%d') AS month_start,
  strftime(m + INTERVAL '1' MONTH, '%Y-%m-%d') AS month_end,
  strftime(m, '%Y_%m') AS month_label,
  EXISTS (SELECT 1 FROM ev WHERE ev.event_month = strftime(m, '%Y-%m')) AS has_events
FROM (SELECT DATE '2024-01-01' + INTERVAL '1' MONTH * k AS m
      FROM (VALUES (-1), (0), (1), (2), (3)) AS k(k)) AS t""")
    repeated = "SELECT 1 FROM ev GROUP BY fleet_id, vehicle_id, hour_bucket HAVING count(*) > 1"
    sql["uniqueness_violations"] = over_events(f"""
SELECT 'events' AS table_name, count(*) AS violations
  FROM (SELECT 1 FROM ev GROUP BY id, recorded_at HAVING count(*) > 1) AS a
UNION ALL SELECT 'vehicles', count(*)
  FROM (SELECT 1 FROM vehicles GROUP BY fleet_id, vin HAVING count(*) > 1) AS b
UNION ALL SELECT 'fleets', 0
UNION ALL SELECT 'hourly', 0
UNION ALL SELECT 'vehicle_hours', count(*) FROM ({repeated}) AS c""")
    sql["repeated_vehicle_hours"] = over_events("""
SELECT fleet_id, vehicle_id, hour_bucket, count(*) AS row_count
FROM ev GROUP BY 1, 2, 3 HAVING count(*) > 1""")
    sql["orphan_vehicles"] = over_events(
        "SELECT id, fleet_id, vin FROM vehicles WHERE fleet_id NOT IN (0, 1, 2, 3)"
    )
    sql["orphan_events"] = over_events("""
SELECT fleet_id, count(*) AS event_count FROM ev
WHERE fleet_id NOT IN (0, 1, 2, 3) GROUP BY fleet_id""")
    sql["cascade_delete"] = over_events(
        "SELECT id, fleet_id, vin FROM vehicles WHERE fleet_id NOT IN (0, 1)"
    )
    sql["insert_if_absent"] = over_events("""
SELECT fleet_id, concat('VIN-', vehicle_id) AS vin, id AS first_event, recorded_at
FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY recorded_at, id) AS n FROM ev)
  AS t
WHERE n = 1 AND fleet_id NOT IN (0, 1, 2)""")
    sql["rollup_upsert"] = over_events(f"""
SELECT *, {as_of} AS computed_at FROM ({HOURLY}) AS h
UNION ALL
SELECT fleet_id, id, TIMESTAMP '2023-12-31 05:00:00', 50.0, 60.0, 40, 1,
  TIMESTAMP '2024-01-15 00:00:00' FROM vehicles""")
    sql["rollup_compacted"] = sql["rollup_upsert"]
    sql["schema_upgrade"] = over_events("""
SELECT CAST(1 AS BIGINT) AS version, id, CAST(NULL AS DOUBLE) AS acceleration, CAST(NULL AS VARCHAR) AS weather,
  CAST(NULL AS BOOLEAN) AS engine_on, '' AS scenarios FROM ev
UNION ALL
SELECT 2, id, CAST(acceleration AS DOUBLE), weather, engine_on,
  CASE WHEN id % 4 = 0 THEN '' ELSE scenarios END FROM ev""")
    sql["schema_downgrade"] = over_events("""
SELECT id, CASE WHEN labels = '' THEN '[]'
    ELSE concat('["', replace(labels, ',', '","'), '"]') END AS stored_text,
  labels AS scenarios
FROM (SELECT id, CASE WHEN id % 4 = 0 THEN '' ELSE scenarios END AS labels FROM ev) AS t""")
    sql["json_export"] = over_events(f"""
SELECT concat('{{"fleet_id":', fleet_id, ',"vehicle_id":', vehicle_id, ',"hour_bucket":"',
  strftime(hour_bucket, '%Y-%m-%dT%H:%M:%S'), '+00:00","avg_speed":', avg_speed,
  ',"max_speed":', max_speed, ',"event_count":', event_count, '}}') AS json
FROM ({HOURLY}) AS h""")
    sql["api_key_verification"] = over_events("""
SELECT id AS vehicle_id, concat('Fleet ', fleet_id) AS fleet,
  sha256(concat('key-', fleet_id)) AS api_key_hash
FROM vehicles WHERE fleet_id < 4""")

    sql["rate_limited"] = recursive(
        "SELECT id, fleet_id, arrival <= granted AS admitted FROM ranked", bucket("ev", 10**9)
    )
    grant_columns = (
        "SELECT fleet_id, CAST(second AS BIGINT) AS second, "
        "CAST(requested AS BIGINT) AS requested, CAST(granted AS BIGINT) AS granted"
    )
    level = "CAST(level AS BIGINT) AS level"
    sql["rate_limited_with_expiry"] = recursive(f"{grant_columns}, {level} FROM buckets", bucket("ev", 3600))
    sql["rate_limited_carried"] = recursive(
        f"{grant_columns}, {level}, CAST(batch AS BIGINT) AS batch, CAST(clock AS BIGINT) AS clock, "
        "CAST(block_seconds AS BIGINT) AS block_seconds FROM buckets, (VALUES (3600), (86400), (2592000)) AS lengths(block_seconds)",
        carried_bucket(3600),
    )
    outcome_rows = """
SELECT fleet_id, status, count(*) AS event_count FROM (
  SELECT fleet_id, CASE WHEN arrival <= granted THEN 'success' ELSE 'rate_limited' END AS status
  FROM ranked
  UNION ALL SELECT fleet_id, 'invalid' FROM reasoned WHERE reasons <> '') AS t
GROUP BY fleet_id, status"""
    sql["ingest_outcomes"] = recursive(outcome_rows, at_once, bucket("valid", 10**9))
    sql["rejections"] = recursive(
        "SELECT fleet_id, count(*) AS rejected FROM ranked WHERE arrival > granted GROUP BY 1",
        bucket("ev", 10**9),
    )
    bounds = "\nUNION ALL\n".join(
        f"SELECT fleet_id, '{bound}' AS upper_bound, "
        f"count(*) FILTER (WHERE lag <= {limit}) AS event_count FROM lags GROUP BY fleet_id"
        for bound, limit in [
            ("0.1", 100_000), ("0.5", 500_000), ("1.0", 1_000_000), ("5.0", 5_000_000),
            ("10.0", 10_000_000), ("30.0", 30_000_000), ("60.0", 60_000_000),
            ("Infinity", 10**15),
        ]
    )
    sql["lag_histogram"] = over_events(
        bounds,
        "\nlags AS (SELECT fleet_id, epoch_us(ingested_at) - epoch_us(recorded_at) AS lag FROM ev)",
    )
    sql["latency_report"] = over_events("""
SELECT event_type AS endpoint, count(*) AS requests,
  count(*) FILTER (WHERE event_type = 'error') AS errors,
  round(count(*) FILTER (WHERE event_type = 'error') / count(*), 7) AS error_rate,
  round(count(*) / ((epoch_us(max(recorded_at)) - epoch_us(min(recorded_at))) / 1000000), 7)
    AS throughput,
  round(avg(duration), 7) AS mean,
  round(quantile_cont(duration, 0.5), 7) AS p50,
  round(quantile_cont(duration, 0.95), 7) AS p95,
  round(quantile_cont(duration, 0.99), 7) AS p99
FROM ev GROUP BY event_type""")
    sql["hit_ratio"] = over_events("""
SELECT event_type AS endpoint, count(*) FILTER (WHERE hit) AS hits,
  count(*) FILTER (WHERE NOT hit) AS misses,
  round(count(*) FILTER (WHERE hit) / count(*), 9) AS hit_ratio
FROM ev GROUP BY event_type""")

    sql["stream_ingest"] = recursive(
        """
SELECT id, fleet_id, vehicle_id, recorded_at, strftime(recorded_at, '%Y-%m') AS event_month,
  CAST(speed AS DOUBLE) AS speed, scenarios
FROM ranked WHERE arrival <= granted""",
        on_arrival,
        bucket("valid", 10**9),
    )
    sql["stream_refused"] = recursive(
        """
SELECT id, fleet_id, vehicle_id, recorded_at, CAST(speed AS DOUBLE) AS speed, ingested_at
FROM ranked WHERE arrival > granted""",
        on_arrival,
        bucket("valid", 10**9),
    )
    sql["stream_outcomes"] = recursive(outcome_rows, on_arrival, bucket("valid", 10**9))
    sql["stream_ingest_repeats"] = recursive(
        outcome_rows + "\nUNION ALL SELECT fleet_id, 'duplicate', count(*) FROM ev WHERE id % 4 = 0 GROUP BY fleet_id",
        on_arrival,
        bucket("valid", 10**9),
    )
    sql["stream_rollup"] = hourly
    sql["stream_windowed_rollup"] = hourly
    # A bucket of the first half is late in the last append once its hour ended an hour before the newest event.
    sql["stream_rollup_late"] = over_events(f"""
SELECT h.*, coalesce(l.corrected, FALSE) AS corrected FROM ({HOURLY}) AS h
LEFT JOIN (
  SELECT DISTINCT fleet_id, vehicle_id, hour_bucket, TRUE AS corrected FROM ev
  WHERE id % 5 = 0 AND recorded_at < TIMESTAMP '2024-01-16 00:00:00'
    AND hour_bucket + INTERVAL '2' HOUR <= (SELECT max(recorded_at) FROM ev)
) AS l USING (fleet_id, vehicle_id, hour_bucket)""")
    sql["stream_latest"] = latest
    sql["stream_latest_batches"] = latest
    sql["stream_rate_limit"] = recursive(f"{grant_columns} FROM buckets", bucket("ev", 3600))
    return sql
