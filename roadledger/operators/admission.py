"""Token-bucket admission per fleet.

Each fleet has a bucket that starts full, gains tokens with time up to its capacity and pays one
token per event; an event that finds less than one token is refused. The clock counts whole
seconds of arrival time, so all events of a second see the same refill and only their number
matters: events are first counted per fleet and second.

The bucket is a sequential recurrence, which would tie a busy fleet to one task. As long as nothing
is refused, though, a second with refill g and cost c turns a level x into min(x + g, full) - c, and
such steps compose: any stretch of them is min(x + moved, most), and nothing in it is refused if
x >= need and floor >= 0. These numbers are running sums, minima and maxima, so they are window
functions, first over the seconds of a block (a day by default), then over the blocks of a fleet.
Fleets that are never refused anything are settled by this alone.

A block that does run short is walked in Python from its start level. For the blocks behind it, a
block that could run short is solved for all start levels at once: its end level is one number for
starts that reach the full bucket first, start + moved for those that meet neither bound, and for
those refused first it depends on nothing but the fraction of a token they start with (a refusal
leaves just the fraction). An aggregate over the blocks of a fleet chains these functions. Each
step holds the blocks or the seconds of one block, whatever the size of the bucket.

Tokens are counted in exact integer parts of a token, so results do not depend on the cuts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import gcd

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadledger.session import shared_dir, written

# The most crowded seconds that are broadcast: two keys and a number each, a few megabytes.
MAX_CROWDED = 100_000
EARLIEST = -(2**62)
# Seconds granted in part that are sent to all tasks: four numbers and an id each, tens of megabytes.
BROADCAST_SECONDS = 200_000


@dataclass(frozen=True)
class TokenBucket:
    """``capacity`` tokens at most; ``refill_tokens`` more every ``refill_seconds``.

    A bucket idle for more than ``idle_seconds`` is full again.
    """

    capacity: int = 1000
    refill_tokens: int = 1000
    refill_seconds: int = 60
    idle_seconds: int = 3600

    def __post_init__(self) -> None:
        if min(self.capacity, self.refill_tokens, self.refill_seconds, self.idle_seconds) < 1:
            raise ValueError("capacity, refill and idle time must be at least 1")

    @property
    def parts(self) -> int:
        """Parts per token."""
        return self.refill_seconds // gcd(self.refill_tokens, self.refill_seconds)

    @property
    def gain(self) -> int:
        """Parts gained per second."""
        return self.refill_tokens // gcd(self.refill_tokens, self.refill_seconds)

    @property
    def full(self) -> int:
        """Capacity in parts."""
        return self.capacity * self.parts


def requests_per_second(events: DataFrame, arrival: str = "ingested_at") -> DataFrame:
    second = F.unix_seconds(arrival)
    return events.groupBy("fleet_id", second.alias("second")).agg(
        F.count("*").alias("requested")
    )


def grants(
    events: DataFrame,
    bucket: TokenBucket = TokenBucket(),
    initial: DataFrame | None = None,
    block_seconds: int = 86_400,
    arrival: str = "ingested_at",
) -> DataFrame:
    """Per fleet and second: events requested and granted, and the bucket level afterwards.

    ``initial`` holds ``(fleet_id, level, second)`` of buckets carried over from earlier events.
    A bucket's clock never runs back: events that arrive late, with a second before that of the
    carried bucket, meet the bucket as it is (``clock`` is the second at which they are judged).

    Seconds and blocks are written, so events are read once.
    """
    spark = events.sparkSession
    folder = shared_dir(spark, "admission")
    counts = requests_per_second(events, arrival)
    counts = counts.withColumn("block", F.floor(F.col("second") / block_seconds).cast("bigint"))
    if initial is None:
        counts = counts.withColumn("clock", F.col("second"))
    else:
        carried = initial.select("fleet_id", F.col("second").alias("carried"))
        counts = counts.join(carried, "fleet_id", "left").withColumn("clock", F.greatest("second", "carried")).drop("carried")
    seconds = written(_steps(counts, bucket), f"{folder}/seconds")
    blocks = written(_planned(_blocks(seconds), bucket, initial), f"{folder}/blocks")
    n_short, n_unsolved = blocks.agg(F.count_if("short"), F.count_if(_to_solve())).first()
    if n_unsolved:
        solved = _functions(seconds.join(blocks.filter(_to_solve()).select("fleet_id", "block"), ["fleet_id", "block"]), bucket)
        blocks = written(_chained(blocks, solved, bucket), f"{folder}/starts")
    started = seconds.join(blocks.select("fleet_id", "block", "start", "short"), ["fleet_id", "block"])
    level = F.least(F.col("start") + F.col("moved"), F.col("moved") + F.col("room"))
    columns = ("fleet_id", "second", "requested", "clock", "granted", "level")
    easy = started.withColumns({"granted": F.col("requested"), "level": level})
    if not n_short:
        return easy.select(*columns)
    result = _keyed(counts, "second bigint, requested bigint, clock bigint, granted bigint, level bigint")
    hard = started.filter("short").select("fleet_id", "block", "second", "requested", "clock", "gain", "start")
    walked = _ordered(hard, ["fleet_id", "block"], "second").mapInPandas(_walk(bucket), result)
    return easy.filter("NOT short").select(*columns).unionByName(walked)


def _refill(gap: Column, bucket: TokenBucket) -> Column:
    """Parts gained in a gap, the whole bucket at most; null for no gap known."""
    enough = (gap > bucket.idle_seconds) | (gap > bucket.full // bucket.gain)
    return F.when(enough, F.lit(bucket.full)).otherwise(gap * bucket.gain).cast("bigint")


def _steps(counts: DataFrame, bucket: TokenBucket) -> DataFrame:
    """Seconds with what a bucket that refuses nothing has moved by since its block began.

    ``gain`` is the refill before a second (0 for the first of a block: its start level counts from
    there). After it the level is the smaller of start + moved and moved + room.
    """
    so_far = Window.partitionBy("fleet_id", "block").orderBy("second")
    gap = F.col("clock") - F.lag("clock").over(so_far)
    # More than the bucket holds is refused whatever its number.
    cost = F.least(F.col("requested"), F.lit(bucket.capacity + 1)) * bucket.parts
    return (
        counts.withColumn("gain", F.coalesce(_refill(gap, bucket), F.lit(0)).cast("bigint"))
        .withColumn("cost", cost)
        .withColumn("moved", F.sum(F.col("gain") - F.col("cost")).over(so_far))
        .withColumn("room", F.min(F.lit(bucket.full) - F.col("cost") - F.col("moved")).over(so_far))
    )


def _blocks(seconds: DataFrame) -> DataFrame:
    """Each block as one step: min(start + moved, most), if start >= need and floor >= 0."""
    level = F.col("moved") + F.col("room")
    return seconds.groupBy("fleet_id", "block").agg(
        F.min("clock").alias("first"),
        F.max("clock").alias("last"),
        F.max_by("moved", "second").alias("moved"),
        F.max_by(level, "second").alias("most"),
        F.max(-F.col("moved")).alias("need"),
        F.min(level).alias("floor"),
    )


def _planned(blocks: DataFrame, bucket: TokenBucket, initial: DataFrame | None) -> DataFrame:
    """Blocks with their start level, right up to the first one of the fleet that runs short.

    ``gain`` is the refill since the block before, ``begun`` the level of the fleet's bucket before
    its first block.
    """
    in_order = Window.partitionBy("fleet_id").orderBy("block")
    fleet = Window.partitionBy("fleet_id")
    if initial is None:
        blocks = blocks.withColumns({"begun": F.lit(bucket.full).cast("bigint"), "since": F.lit(None).cast("bigint")})
    else:
        carried = initial.select("fleet_id", F.col("level").alias("begun"), F.col("second").alias("since"))
        blocks = blocks.join(carried, "fleet_id", "left").withColumn("begun", F.coalesce("begun", F.lit(bucket.full)).cast("bigint"))
    gap = F.col("first") - F.coalesce(F.lag("last").over(in_order), "since")
    return (
        blocks.withColumn("gain", F.coalesce(_refill(gap, bucket), F.lit(bucket.full)).cast("bigint"))
        .withColumn("sum", F.sum(F.col("gain") + F.col("moved")).over(in_order))
        .withColumn("cap", F.min(F.col("most") - F.col("sum")).over(in_order))
        .withColumn("after", F.least(F.col("begun") + F.col("sum"), F.col("sum") + F.col("cap")))
        .withColumn("start", F.least(F.lit(bucket.full).cast("bigint"), F.coalesce(F.lag("after").over(in_order), "begun") + F.col("gain")))
        .withColumn("short", _runs_short())
        .withColumn("first_short", F.min(F.when(F.col("short"), F.col("block"))).over(fleet))
        .withColumn("last_block", F.max("block").over(fleet))
        .drop("sum", "cap", "after", "since")
    )


def _runs_short() -> Column:
    return (F.col("start") < F.col("need")) | (F.col("floor") < 0)


def _to_solve() -> Column:
    """Blocks whose end must be known for other starts than the planned one."""
    at_risk = (F.col("need") > 0) | (F.col("floor") < 0)
    return at_risk & (F.col("block") >= F.col("first_short")) & (F.col("block") < F.col("last_block"))


FUNCTION = "low bigint, top bigint, shift bigint, capped bigint, starts array<bigint>, ends array<bigint>, slopes array<bigint>"


def _functions(seconds: DataFrame, bucket: TokenBucket) -> DataFrame:
    """Blocks with their end level as a function of the start level (see :func:`_solve`)."""
    rows = seconds.select("fleet_id", "block", "second", "gain", "cost")
    return _ordered(rows, ["fleet_id", "block"], "second").mapInPandas(_solve(bucket), _keyed(seconds, f"block bigint, {FUNCTION}"))


def _chained(blocks: DataFrame, solved: DataFrame, bucket: TokenBucket) -> DataFrame:
    """Blocks with their true start levels, from one block to the next of a fleet."""

    def end(block: Column, start: Column) -> Column:
        fraction = start % bucket.parts
        piece = F.size(F.filter(block["starts"], lambda s: s <= fraction)) - 1
        refused = F.get(block["ends"], piece) + F.get(block["slopes"], piece) * (fraction - F.get(block["starts"], piece))
        solved_end = F.when(start < block["low"], refused).when(start <= block["top"], start + block["shift"]).otherwise(block["capped"])
        fits = (start >= block["need"]) & (block["floor"] >= 0)
        return F.when(fits, F.least(start + block["moved"], block["most"])).otherwise(solved_end)

    def step(state: Column, block: Column) -> Column:
        start = F.least(F.lit(bucket.full).cast("bigint"), state["level"] + block["gain"])
        return F.struct(end(block, start).alias("level"), F.array_append(state["starts"], start).alias("starts"))

    own = ("block", "gain", "moved", "most", "need", "floor")
    short = blocks.filter(F.col("first_short").isNotNull()).join(solved, ["fleet_id", "block"], "left")
    one = F.struct(*own, "low", "top", "shift", "capped", "starts", "ends", "slopes")
    chained = (
        short.groupBy("fleet_id", "begun")
        .agg(F.sort_array(F.collect_list(one)).alias("blocks"))
        .select(
            "fleet_id",
            "blocks",
            F.aggregate("blocks", F.struct(F.col("begun").alias("level"), F.array().cast("array<bigint>").alias("starts")), step)["starts"].alias("known"),
        )
        .select("fleet_id", F.inline(F.arrays_zip("blocks", "known")))
        .select("fleet_id", "blocks.block", F.col("known").alias("start"), "blocks.need", "blocks.floor")
        .withColumn("short", _runs_short())
    )
    columns = ("fleet_id", "block", "start", "short")
    return blocks.filter(F.col("first_short").isNull()).select(*columns).unionByName(chained.select(*columns))


def _ordered(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of one key together and in order.

    Python then walks over a partition with a few numbers in hand, whatever the number of keys.
    The partition count is given, as adaptive execution would judge by size and leave all the
    steps of small rows to one task.
    """
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, *key).sortWithinPartitions(*key, order)


def _keyed(counts: DataFrame, columns: str) -> T.StructType:
    key = T.StructField("fleet_id", counts.schema["fleet_id"].dataType)
    return T.StructType([key, *T.StructType.fromDDL(columns).fields])


def carried_over(granted: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """The buckets after these grants, to pass on as ``initial``: one row per fleet."""
    last = granted.select("fleet_id", "level", "clock", "second")
    if initial is not None:
        before = initial.select("fleet_id", "level", F.col("second").alias("clock"), F.lit(EARLIEST).alias("second"))
        last = last.unionByName(before)
    # Late events share the clock of the carried bucket; of these the last second counts.
    return last.groupBy("fleet_id").agg(
        F.max_by("level", F.struct("clock", "second")).alias("level"), F.max("clock").alias("second")
    )


def admit(
    events: DataFrame,
    granted: DataFrame,
    bucket: TokenBucket = TokenBucket(),
    arrival: str = "ingested_at",
    rows_per_salt: int = 5_000_000,
) -> DataFrame:
    """The events with a boolean ``admitted``: in each second the earliest, up to the grant.

    Equal arrival times are settled by ``id``, which must be unique. ``granted`` is read several
    times and should be a written table; it has one row per fleet and active second.

    Seconds granted in full need no look at single events. For a second granted in part, the
    last admitted event is found by ranking, and written with the second. A second so crowded that
    one task should not handle it is dealt out over several by salt, each keeping at most
    ``capacity`` candidates. Up to ``BROADCAST_SECONDS`` such seconds are sent to the events, which
    then are not shuffled at all; beyond, both are shuffled.
    """
    spark = events.sparkSession
    partly = F.col("granted") < F.col("requested")
    total, n_short, most = granted.agg(F.sum("requested"), F.count_if(partly), F.max(F.when(partly, F.col("requested")))).first()
    if not n_short:
        return events.withColumn("admitted", F.lit(True))
    sent = F.broadcast if n_short <= BROADCAST_SECONDS else lambda rows: rows
    second = F.unix_seconds(arrival)
    # A crowded second has more than per_salt events, so there are fewer than MAX_CROWDED of them.
    per_salt = max(rows_per_salt, total // MAX_CROWDED)
    short = granted.filter(F.col("granted") < F.col("requested")).select(
        "fleet_id", "second", "granted", F.ceil(F.col("requested") / per_salt).alias("salts")
    )
    crowded = short.filter("salts > 1").select("fleet_id", "second", "salts")

    def dealt(rows: DataFrame) -> DataFrame:
        salt = F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1)))
        joined = rows.join(F.broadcast(crowded), ["fleet_id", "second"], "left")
        return joined.withColumn("salt", salt).drop("salts")

    def for_every_salt(seconds: DataFrame) -> DataFrame:
        salts = F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)
        return seconds.withColumn("salt", F.explode(salts)).drop("salts")

    slim = events.select("fleet_id", second.alias("second"), F.col(arrival).alias("arrival"), "id")
    arrived = [F.asc("arrival"), F.asc("id")]
    if most > per_salt:
        per_salt_rank = Window.partitionBy("fleet_id", "second", "salt").orderBy(*arrived)
        candidates = (
            dealt(slim)
            .join(sent(for_every_salt(short.filter("granted > 0"))), ["fleet_id", "second", "salt"])
            .withColumn("rank", F.row_number().over(per_salt_rank))
            .filter(F.col("rank") <= bucket.capacity)
        )
    else:
        candidates = slim.join(sent(short.filter("granted > 0")), ["fleet_id", "second"])
    cutoffs = (
        candidates.withColumn("rank", F.row_number().over(Window.partitionBy("fleet_id", "second").orderBy(*arrived)))
        .filter(F.col("rank") == F.col("granted"))
        .select("fleet_id", "second", F.struct("arrival", "id").alias("cutoff"))
    )
    limits = short.join(cutoffs, ["fleet_id", "second"], "left").select(
        "fleet_id", "second", "salts", F.lit(True).alias("short"), "cutoff"
    )
    limits = written(limits, shared_dir(spark, "admission-limits"))
    arrived_as = F.struct(F.col(arrival).alias("arrival"), F.col("id").alias("id"))
    within = F.coalesce(arrived_as <= F.col("cutoff"), F.lit(False))
    admitted = (F.col("short").isNull() | within).alias("admitted")
    if n_short <= BROADCAST_SECONDS or most <= per_salt:
        limits = sent(limits)
        found = events.withColumn("second", second).join(limits, ["fleet_id", "second"], "left")
    else:
        found = dealt(events.withColumn("second", second)).join(for_every_salt(limits), ["fleet_id", "second", "salt"], "left")
    return found.select(*events.columns, admitted)


def outcomes(granted: DataFrame) -> DataFrame:
    """Events per fleet and status, straight from the grants; no event is looked at again."""
    counts = granted.groupBy("fleet_id").agg(
        F.sum("granted").alias("success"),
        F.sum(F.col("requested") - F.col("granted")).alias("rate_limited"),
    )
    statuses = [
        F.struct(F.lit(name).alias("status"), F.col(name).alias("event_count"))
        for name in ("success", "rate_limited")
    ]
    return counts.select("fleet_id", F.inline(F.array(*statuses))).filter("event_count > 0")


# The functions below run in Python workers, over rows sorted by key. They are built as closures
# over plain numbers so that they travel by value and workers need not have this package.


def _solve(bucket: TokenBucket):
    full, parts = bucket.full, bucket.parts
    names = ["fleet_id", "block", "low", "top", "shift", "capped", "starts", "ends", "slopes"]

    def after(level: int, cost: int) -> int:
        return level - cost if level >= cost else level % parts

    def joined(pieces: list) -> list:
        """Neighbouring pieces that are one straight line put together."""
        out = pieces[:1]
        for piece in pieces[1:]:
            start, level, slope, end = out[-1]
            if slope == piece[2] and piece[1] == level + slope * (end - start):
                out[-1] = (start, level, slope, piece[3])
            else:
                out.append(piece)
        return out

    def stepped(pieces: list, gain: int, cost: int) -> list:
        """Each piece after one second: cut where the bucket is full and between whole tokens."""
        out = []
        for start, level, slope, end in pieces:
            level += gain
            if slope:
                under = min(end, start + max(0, full - level + 1))
                while start < under:
                    stop = min(under, start + parts - level % parts)
                    out.append((start, after(level, cost), 1, stop))
                    level += stop - start
                    start = stop
            if start < end:
                out.append((start, after(min(level, full), cost), 0, end))
        return joined(out)

    def refused_now(pieces: list, first: int, last: int, gained: int) -> list:
        """Fractions first to last - 1 are left with what they have gained, beyond whole tokens."""
        out = [(start, level, slope, min(end, first)) for start, level, slope, end in pieces if start < first]
        turn = max(first, min(last, parts - gained))  # from here on the fraction has wrapped
        if first < turn:
            out.append((first, first + gained, 1, turn))
        if turn < last:
            out.append((turn, turn + gained - parts, 1, last))
        for start, level, slope, end in pieces:
            if end > last:
                out.append((max(start, last), level + slope * (max(start, last) - start), slope, end))
        return joined(out)

    def solve(gains: list, costs: list) -> tuple:
        """End level of a block as a function of its start level.

        Starts below ``low`` are refused something before they meet the full bucket, those above
        ``top`` reach it first, the others meet neither and move by ``shift``. All that reach it are
        one from then on. All of one fraction that are refused are one, too: the fraction is what
        a refusal leaves. Their levels are kept as straight pieces (start, level, slope, end) over
        the fraction, level or rising by one; there are a few of them, whatever the bucket.
        """
        low, top, shift, gained = 0, full, 0, 0
        pieces, capped = [(0, 0, 0, parts)], 0
        for gain, cost in zip(gains, costs):
            gained = (gained + gain) % parts
            pieces = stepped(pieces, gain, cost)
            capped = after(min(capped + gain, full), cost)
            if low <= top:
                bound = full - shift - gain
                if bound < top:
                    capped, top = after(full, cost), max(bound, low - 1)
                shift += gain - cost
                if -shift > low and low <= top:
                    refused = min(-shift, top + 1)
                    first, count = low % parts, min(refused - low, parts)
                    pieces = refused_now(pieces, first, min(first + count, parts), gained)
                    if first + count > parts:
                        pieces = refused_now(pieces, 0, first + count - parts, gained)
                    low = refused
        starts, ends, slopes, _ = (list(column) for column in zip(*pieces))
        return low, top, shift, capped, starts, ends, slopes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        key, gains, costs = None, [], []
        for batch in batches:
            fleets, blocks = batch["fleet_id"].to_numpy(), batch["block"].to_numpy()
            gain, cost = batch["gain"].tolist(), batch["cost"].tolist()
            change = (fleets[1:] != fleets[:-1]) | (blocks[1:] != blocks[:-1])
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
            done = []
            for begin, end in zip(edges, edges[1:]):
                if begin == end:
                    continue
                if key != (fleets[begin], blocks[begin]):
                    if key is not None:
                        done.append((*key, *solve(gains, costs)))
                    key, gains, costs = (fleets[begin], blocks[begin]), [], []
                gains += gain[begin:end]
                costs += cost[begin:end]
            yield pd.DataFrame(done, columns=names)
        if key is not None:
            yield pd.DataFrame([(*key, *solve(gains, costs))], columns=names)

    return run


def _walk(bucket: TokenBucket):
    full, parts = bucket.full, bucket.parts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        key, level = None, full
        for batch in batches:
            fleets, blocks = batch["fleet_id"].to_numpy(), batch["block"].to_numpy()
            gains, requested = batch["gain"].tolist(), batch["requested"].tolist()
            change = (fleets[1:] != fleets[:-1]) | (blocks[1:] != blocks[:-1])
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
            granted, levels = [], []
            for begin, end in zip(edges, edges[1:]):
                if begin < end and key != (fleets[begin], blocks[begin]):
                    key, level = (fleets[begin], blocks[begin]), int(batch["start"].iloc[begin])
                for gain, wanted in zip(gains[begin:end], requested[begin:end]):
                    level = min(full, level + gain)
                    grant = min(wanted, level // parts)
                    level -= grant * parts
                    granted.append(grant)
                    levels.append(level)
            decided = batch[["fleet_id", "second", "requested", "clock"]]
            yield decided.assign(granted=granted, level=levels)

    return run
