"""The ingest stream: check, admit, tag, append.

Every micro-batch is a few batch jobs on the same operators the batch side uses. A batch that is
run again after a failure gives the same result: its checked rows are written to a staging folder
first and reused, and each output is replaced under the batch's own folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadledger.functions.expressions import row_id
from roadledger.operators.admission import TokenBucket, admit, carried_over, grants, outcomes
from roadledger.operators.reports import invalid_counts, outcome_counts
from roadledger.operators.validate import check, settled
from roadledger.session import is_complete, path_exists, query_label, use_utc, written
from roadledger.sources.events import append_events, read_events


@dataclass(frozen=True)
class IngestPaths:
    """Folders of one ingest job, all in storage every executor can reach."""

    root: str

    @property
    def events(self) -> str:
        return f"{self.root}/events"

    @property
    def quarantine(self) -> str:
        return f"{self.root}/quarantine"

    @property
    def refused(self) -> str:
        return f"{self.root}/rate_limited"

    @property
    def outcomes(self) -> str:
        return f"{self.root}/outcomes"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"

    def batch(self, name: str, label: str) -> str:
        return f"{self.root}/{name}/ingest_batch={label}"


def ingest_batch(
    raw: DataFrame,
    batch_id: int,
    paths: IngestPaths,
    bucket: TokenBucket = TokenBucket(),
    uuid_keys: bool = True,
    run: str = "",
    repeats: DataFrame | None = None,
) -> None:
    """One batch of landing rows (text fields and ``arrived_at``); ``run`` tells jobs on one folder apart.

    ``repeats`` are counts (fleet_id, event_count) of rows left out as sent before, for the outcomes.

    Rows with defects are set aside and cost no token. Ids are drawn once, when the checked rows
    are staged. The bucket of each fleet goes from batch to batch as a small table; fleets idle
    long enough to be full again are left out of it. The first batch of a run starts with full
    buckets; a later one needs the table of the batch before it.
    """
    spark = use_utc(raw.sparkSession)
    label, before = (f"{run}-{n}" if run else str(n) for n in (batch_id, batch_id - 1))
    identified = raw
    if "id" not in raw.columns:
        identified = raw.withColumn("id", row_id(paths.root, label))
    staged = written(
        settled(check(identified, F.col("arrived_at"), uuid_keys)),
        paths.batch("staged", label),
        reuse=True,
    )
    refused = staged.filter(F.size("reasons") > 0).drop("event").select("*", "raw.*").drop("raw")
    refused.write.mode("overwrite").parquet(paths.batch("quarantine", label))

    events = staged.filter(F.size("reasons") == 0).select(
        "id", F.col("arrived_at").alias("ingested_at"), "event.*"
    )
    carried = None
    previous = paths.batch("buckets", before)
    if batch_id > 0:
        if not is_complete(spark, previous):
            raise FileNotFoundError(f"no buckets of the batch before: {previous}")
        carried = spark.read.parquet(previous)
    granted = written(grants(events, bucket, carried), paths.batch("grants", label))
    judged = admit(events, granted, bucket)  # a join with the few seconds granted in part, cheap to plan twice
    append_events(judged.filter("admitted").drop("admitted"), paths.events, label)
    if not granted.filter(F.col("granted") < F.col("requested")).isEmpty():
        # Kept, so that a sender or an operator can send them again.
        late = judged.filter(~F.col("admitted")).drop("admitted")
        late.write.mode("overwrite").parquet(paths.batch("rate_limited", label))

    key = events.schema["fleet_id"].dataType
    invalid = invalid_counts(refused.withColumn("fleet_id", F.col("fleet_id").cast(key)))
    counted = outcomes(granted).unionByName(invalid)
    if repeats is not None:
        again = repeats.select(F.col("fleet_id").try_cast(key).alias("fleet_id"), F.lit("duplicate").alias("status"), "event_count")
        counted = counted.unionByName(again)
    counted.write.mode("overwrite").parquet(paths.batch("outcomes", label))

    left = carried_over(granted, carried)
    newest = left.agg(F.max("second")).first()[0]
    if newest is not None:
        left = left.filter(F.col("second") >= newest - bucket.idle_seconds)
    left.write.mode("overwrite").parquet(paths.batch("buckets", label))


def marked_repeats(landing: DataFrame, within: str) -> DataFrame:
    """Every landing row twice: once with ``fresh`` unless it was sent before, once bare for counting.

    Two rows are the same if all their fields are but the arrival. The state keeps a digest per row
    for as long as ``within``, by the clock of the job, so no row is ever too late for it.
    """
    names = [name for name in landing.columns if name != "arrived_at"]
    digest = F.md5(F.to_json(F.struct(*sorted(names))))
    seen = landing.withColumns({"_digest": digest, "_seen_at": F.current_timestamp()}).withWatermark("_seen_at", within)
    fresh = seen.dropDuplicatesWithinWatermark(["_digest"])
    bare = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "fleet_id" else F.col("fleet_id") for f in landing.schema]
    return fresh.select(*landing.columns, F.lit(True).alias("fresh")).unionByName(seen.select(*bare, F.lit(False).alias("fresh")))


def start_ingest(
    landing: DataFrame,
    paths: IngestPaths,
    bucket: TokenBucket = TokenBucket(),
    uuid_keys: bool = True,
    trigger: dict | None = None,
    repeats_within: str | None = None,
) -> StreamingQuery:
    """Run the ingest over a landing stream; by default until the present files are done.

    With ``repeats_within`` (such as "1 hour") a row that was already sent in that time is stored
    once; the others are counted as ``duplicate`` in the outcomes and cost no token.
    """

    def one(raw: DataFrame, batch_id: int) -> None:
        run = query_label(raw.sparkSession, paths.checkpoint)
        if repeats_within is None:
            ingest_batch(raw, batch_id, paths, bucket, uuid_keys, run)
            return
        # Written first: the counts and the ingest then read one and the same result of the state.
        both = written(raw, paths.batch("received", f"{run}-{batch_id}"), reuse=True)
        change = F.when(F.col("fresh"), -1).otherwise(1)
        repeats = both.groupBy("fleet_id").agg(F.sum(change).alias("event_count")).filter("event_count > 0")
        ingest_batch(both.filter("fresh").drop("fresh"), batch_id, paths, bucket, uuid_keys, run, repeats)

    rows = landing if repeats_within is None else marked_repeats(landing, repeats_within)
    return (
        rows.writeStream.foreachBatch(one)
        .option("checkpointLocation", paths.checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_refused(spark: SparkSession, paths: IngestPaths) -> DataFrame:
    """Valid events the limiter refused, over all batches, in the columns of the stored ones."""
    if path_exists(spark, paths.refused):
        return use_utc(spark).read.parquet(paths.refused)
    return read_events(spark, paths.events).limit(0)  # it never refused one


def read_outcomes(spark: SparkSession, paths: IngestPaths) -> DataFrame:
    """Events per fleet and status over all batches."""
    return outcome_counts(spark.read.parquet(paths.outcomes))
