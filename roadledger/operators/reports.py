"""Reports over ingest outcomes and request logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadledger.session import shared_dir, written

# Histogram bounds in seconds.
INGEST_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
TASK_BOUNDS = (0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0)
PERCENTILES = (0.5, 0.95, 0.99)
# Tables of a few numbers per row are broadcast up to this many rows, some ten megabytes.
BROADCAST_ROWS = 100_000
SALTS = 64
# Pieces that a bracket is cut into per round.
GRID = 64


def invalid_counts(refused: DataFrame) -> DataFrame:
    """Rows per fleet that failed the ingest checks, in the form of admission outcomes."""
    counts = refused.groupBy("fleet_id").agg(F.count("*").alias("event_count"))
    return counts.select("fleet_id", F.lit("invalid").alias("status"), "event_count")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Events per fleet and ingest status over any number of partial counts."""
    return outcomes.groupBy("fleet_id", "status").agg(F.sum("event_count").alias("event_count"))


def rejection_counts(outcomes: DataFrame) -> DataFrame:
    """Events per fleet refused by the rate limit."""
    limited = outcomes.filter(F.col("status") == "rate_limited")
    return limited.groupBy("fleet_id").agg(F.sum("event_count").alias("rejected"))


def ingest_lag() -> Column:
    """Seconds between recording and ingest, exact to the microsecond."""
    micros = F.unix_micros("ingested_at") - F.unix_micros("recorded_at")
    return micros / F.lit(1_000_000)


def histogram(
    rows: DataFrame, duration: Column, bounds: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Cumulative counts (``upper_bound``, ``event_count``), the last bound being infinity.

    All bounds are counted in one pass; the rows are then turned from columns to lines.
    """
    measured = rows.select(*by, duration.alias("_d"))
    counts = measured.groupBy(*by).agg(
        *[F.count_if(F.col("_d") <= bound).alias(f"b{i}") for i, bound in enumerate(bounds)],
        F.count("_d").alias("b_inf"),
    )
    pairs = [
        F.struct(F.lit(float(bound)).alias("upper_bound"), F.col(f"b{i}").alias("event_count"))
        for i, bound in enumerate(bounds)
    ]
    pairs.append(
        F.struct(
            F.lit(float("inf")).alias("upper_bound"), F.col("b_inf").alias("event_count")
        )
    )
    return counts.select(*by, F.inline(F.array(*pairs)))


def exact_percentiles(
    rows: DataFrame,
    value: str,
    by: Sequence[str] = (),
    fractions: Sequence[float] = PERCENTILES,
    accuracy: int = 20_000,
    bound: int = 1_000_000,
) -> DataFrame:
    """Exact interpolated percentiles by the rule ``p * (n - 1)``: a row per group and fraction.

    ``percentile`` keeps every distinct value of a group in one task. Here brackets around the wanted
    ranks are narrowed in rounds until none holds more than ``bound`` rows of different values, and
    only those are counted singly and sorted, each bracket as its own window group. A quantile
    sketch of a bracket proposes where to cut it; the rows of every piece are counted, so the result
    is exact whatever the sketch's error. Rows outside the brackets are left behind after each
    round, which runs at once; a group of 10**12 rows takes about three.
    """
    group = list(by) or ["_all"]
    present = rows.filter(F.col(value).isNotNull()).select(
        *(by or [F.lit(0).alias("_all")]), F.col(value).alias("value")
    )
    targets, inside = narrowed(present, group, fractions, accuracy, bound)
    by_value = Window.partitionBy(*group, "start").orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    through = F.col("start") + F.sum("n").over(by_value)
    counted = (
        inside.groupBy(*group, "start", "value")
        .agg(F.count("*").alias("n"))
        .select(*group, "start", "value", "n", through.alias("through"))
    )
    holds = (F.col("rank") < F.col("through")) & (F.col("rank") >= F.col("through") - F.col("n"))
    columns = (*group, "fraction", "position", "rank", "value")
    looked_up = counted.join(targets.filter("lo < hi").drop("n"), [*group, "start"]).filter(holds)
    alone = targets.filter("lo = hi").withColumn("value", F.col("lo"))
    share = F.col("position") - F.floor("position")
    result = (
        looked_up.select(*columns).unionByName(alone.select(*columns))
        .groupBy(*group, "fraction", "position")
        .agg(F.min_by("value", "rank").alias("low"), F.max_by("value", "rank").alias("high"))
    )
    return result.select(
        *by, "fraction", (F.col("low") + share * (F.col("high") - F.col("low"))).alias("percentile")
    )


def narrowed(
    present: DataFrame, group: list[str], fractions: Sequence[float], accuracy: int, bound: int
) -> tuple[DataFrame, DataFrame]:
    """The wanted ranks with their brackets, and the rows of those brackets.

    A bracket is named by its ``start``, the number of rows of the group before it; it has ``n``
    rows from ``lo`` to ``hi``. Brackets with one value only have no rows here.
    """
    spark = present.sparkSession
    folder = shared_dir(spark, "percentiles")
    margin = 2 / accuracy
    cuts = sorted({min(max(p + side, 0.0), 1.0) for p in fractions for side in (-margin, margin)})
    inside = present.withColumn("start", F.lit(0).cast("bigint"))
    targets, step = None, 0
    while True:
        ranged, pieces = _pieces(inside, group, cuts, accuracy, f"{folder}/edges-{step}")
        pieces = written(pieces, f"{folder}/pieces-{step}")
        if targets is None:
            targets = _ranks(pieces, group, fractions)
        found = (
            targets.select(*group, "start", "fraction", "position", "rank")
            .join(pieces.drop("total"), [*group, "start"])
            .filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
        )
        found = written(found, f"{folder}/ranks-{step}")
        kept = found.filter("lo < hi").select(*group, "start", "range", "before").distinct()
        inside = _attach(ranged, written(kept, f"{folder}/kept-{step}"), [*group, "start", "range"])
        inside = written(inside.select(*group, "value", F.col("before").alias("start")), f"{folder}/inside-{step}")
        done = targets.filter("lo = hi") if "lo" in targets.columns else None
        targets = found.select(*group, "fraction", "position", "rank", F.col("before").alias("start"), "n", "lo", "hi")
        if done is not None:
            targets = targets.unionByName(done.select(*targets.columns))
        if targets.filter((F.col("n") > bound) & (F.col("lo") < F.col("hi"))).isEmpty():
            return targets, inside
        cuts, step = [k / GRID for k in range(GRID + 1)], step + 1


def _pieces(
    inside: DataFrame, group: list[str], cuts: Sequence[float], accuracy: int, path: str
) -> tuple[DataFrame, DataFrame]:
    """Rows with their piece of the bracket, and the pieces with their exact counts.

    A cut's own value is a piece by itself, so every round leaves some values behind.
    """
    key = [*group, "start"]
    edges = inside.groupBy(*key).agg(F.percentile_approx("value", list(cuts), accuracy).alias("edges"))
    edges = written(edges, path)
    passed = [
        (F.col("edges")[i] < F.col("value")).cast("int") + (F.col("edges")[i] <= F.col("value")).cast("int")
        for i in range(len(cuts))
    ]
    ranged = _attach(inside, edges, key).select(*key, "value", reduce(Column.__add__, passed).alias("range"))
    in_order = Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = ranged.groupBy(*key, "range").agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    return ranged, pieces.select(
        *key, "range", "n", "lo", "hi",
        (F.col("start") + F.sum("n").over(in_order) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy(*key)).alias("total"),
    )


def _ranks(pieces: DataFrame, group: list[str], fractions: Sequence[float]) -> DataFrame:
    """The one or two ranks that each percentile of a group lies at."""
    position = F.col("fraction") * (F.col("total") - 1)
    ranks = F.array_distinct(F.array(F.floor("position"), F.ceil("position")))
    return (
        pieces.select(*group, "start", "total").distinct()
        .select("*", F.explode(F.lit(list(map(float, fractions)))).alias("fraction"))
        .withColumn("position", position)
        .withColumn("rank", F.explode(ranks))
    )


def _attach(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Join a written table with one row per key to the rows.

    It is broadcast when its counted size allows. Otherwise every key is dealt out over salts, so
    that a key holding much of the rows does not end in one task.
    """
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key)
    salts = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    return dealt.join(salts, [*key, "salt"]).drop("salt")


def latency_report(
    log: DataFrame,
    by: Sequence[str] = (),
    duration: str = "duration",
    status: str = "status",
    moment: str = "requested_at",
) -> DataFrame:
    """Requests, errors, throughput, mean and p50/p95/p99 of a request log, per group.

    A status other than 200 or 201 is an error. Throughput is requests per second between the
    first and the last request.
    """
    group = list(by) or ["_all"]
    log = log if by else log.withColumn("_all", F.lit(0))
    seconds = (F.unix_micros(F.max(moment)) - F.unix_micros(F.min(moment))) / F.lit(1_000_000)
    totals = log.groupBy(*group).agg(
        F.count("*").alias("requests"),
        F.count_if(~F.coalesce(F.col(status).isin(200, 201), F.lit(False))).alias("errors"),
        F.avg(duration).alias("mean"),
        seconds.alias("seconds"),
    )
    percentiles = (
        exact_percentiles(log, duration, group)
        .groupBy(*group)
        .agg(*[
            F.max(F.when(F.col("fraction") == p, F.col("percentile"))).alias(f"p{round(p * 100)}")
            for p in PERCENTILES
        ])
    )
    return totals.join(percentiles, group, "left").select(
        *by,
        "requests",
        "errors",
        (F.col("errors") / F.col("requests")).alias("error_rate"),
        (F.col("requests") / F.nullif("seconds", F.lit(0.0))).alias("throughput"),
        "mean",
        *[f"p{round(p * 100)}" for p in PERCENTILES],
    )


def hit_ratio(log: DataFrame, endpoint: str = "endpoint", hit: str = "hit") -> DataFrame:
    """Lookups answered from stored results, per endpoint."""
    counts = log.groupBy(endpoint).agg(
        F.count_if(hit).alias("hits"), F.count_if(~F.col(hit)).alias("misses")
    )
    return counts.withColumn("hit_ratio", F.col("hits") / (F.col("hits") + F.col("misses")))
