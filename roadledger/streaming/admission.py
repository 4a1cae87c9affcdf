"""Token buckets kept in a stream's state store."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from roadledger.operators.admission import TokenBucket

# transformWithState needs this state store.
STATE_STORE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
}


def stream_grants(
    events: DataFrame, bucket: TokenBucket = TokenBucket(), arrival: str = "ingested_at"
) -> DataFrame:
    """A stream of ``(fleet_id, second, requested, granted)``, buckets living in stream state.

    For continuous decisions with little delay. Events are counted per fleet and second before
    they are shuffled, so a busy fleet sends a few numbers per task. The ingest job uses the block
    form of ``operators.admission`` instead, which also splits a busy fleet's timeline.
    """
    key = events.schema["fleet_id"].dataType
    output = T.StructType(
        [
            T.StructField("fleet_id", key),
            T.StructField("second", T.LongType()),
            T.StructField("requested", T.LongType()),
            T.StructField("granted", T.LongType()),
        ]
    )
    arrivals = events.select("fleet_id", F.unix_seconds(arrival).alias("second"))
    counted = T.StructType([*output.fields[:2], T.StructField("requested", T.LongType())])
    counts = arrivals.mapInPandas(_count_by_second(), counted)
    return counts.groupBy("fleet_id").transformWithStateInPandas(
        statefulProcessor=_processor(bucket),
        outputStructType=output,
        outputMode="Update",
        timeMode="None",
    )


# Both functions below are closures so that workers need not have this package installed.


def _count_by_second():
    """Map-side counts, which a stream cannot get from an aggregation in front of its state."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            batch = batch.assign(requested=1)
            held = batch if held is None else pd.concat([held, batch])
            held = held.groupby(["fleet_id", "second"], as_index=False).sum()
            if len(held) > 100_000:
                yield held
                held = None
        if held is not None:
            yield held

    return count


def _processor(bucket: TokenBucket) -> StatefulProcessor:
    full, parts, gain, idle = bucket.full, bucket.parts, bucket.gain, bucket.idle_seconds

    class BucketProcessor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.bucket = handle.getValueState("bucket", "level bigint, second bigint")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
            requested: Counter = Counter()
            for chunk in rows:
                requested.update(chunk.groupby("second")["requested"].sum().to_dict())
            level, last = full, None
            if self.bucket.exists():
                level, last = self.bucket.get()
            decided = []
            for second in sorted(requested):
                gap = 0 if last is None else max(0, second - last)
                last = second if last is None else max(last, second)
                level = full if gap > idle else min(full, level + gap * gain)
                granted = min(requested[second], level // parts)
                level -= granted * parts
                decided.append((key[0], second, requested[second], granted))
            self.bucket.update((int(level), int(last)))
            yield pd.DataFrame(decided, columns=["fleet_id", "second", "requested", "granted"])

        def close(self) -> None:
            pass

    return BucketProcessor()
