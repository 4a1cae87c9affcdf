"""Benchmark decontamination: documents that hold an item of a benchmark, or nearly.

Texts are lower-cased and cut into words of letters and digits (all other ASCII characters separate);
a shingle is five consecutive words. A document is contaminated by an item if some stretch of as many
shingles as the item has is at least ``percent`` alike: shared shingles over all shingles, each
weighted by how often it occurs on either side. A shorter document is one stretch.

1. The places of a document that hold a shingle of some item are its anchors. An alike stretch needs
   8 anchors in 9 places at least (of items of its size), so documents without any are done, and
   in the others few stretches are left: about seven around each passage. Running counts over the
   anchors give the spans of such starts, so the work grows with the length of a text.
2. These stretches get a 63-bit SimHash, each occurrence of a shingle voting on every bit. Votes are
   added in packed counters, seven to a number.
3. The fingerprint is cut into ``radius + 1`` blocks; two fingerprints that differ in at most
   ``radius`` bits agree in some block. At 0.8 alike about nine bits differ; 20 are allowed, and blocks
   of three bits alone would select next to nothing. So the index is keyed as well: an alike stretch
   misses at most a fifth of an item's shingles, so it holds one of any larger choice of them, and of
   each item the rarest (among items) are chosen. An equi-join on (stretch size, chosen shingle,
   block, bits) finds all fingerprints within the radius that can be alike. It joins distinct bare
   fingerprints; shingles are fetched for what is left.
4. Pairs within the radius are verified on the shingles themselves.

Everything is DataFrame functions. The item tables are written first, so Spark plans their joins by
their size; anchors are sent to all executors only below ``BROADCAST_ANCHORS`` rows.

Defined results: null texts, texts and items of fewer than five words match nothing. Rows that share
an id are one document: each of them carries what any of them holds; repeated items are all
reported; rows with a null id are never contaminated. Empty tables give empty or clean results. Extra
columns are ignored by :func:`matches` and carried by :func:`clean`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadledger.session import shared_dir, written

BROADCAST_ANCHORS = 1_000_000
# Starts of a text that are looked at together, at least.
GRID = 256
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Seven counters of eight bits leave the sign of a number alone.
LANES, NUMBERS = 7, 9
BITS = LANES * NUMBERS


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 80
    radius: int = 20


def with_shingles(rows: DataFrame, text: str, name: str, size: int) -> DataFrame:
    """``rows`` with an array of shingle hashes, in order, in place of the text.

    The words pass through a generator: filters on what is made of them cannot be moved below it,
    where each look at a word would cut the text again.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), NOT_WORD, -1), lambda w: w != "")
    frame = rows.select("*", F.explode_outer(F.array(words)).alias("dc_words")).drop(text)
    starts = F.when(F.size("dc_words") >= size, F.sequence(F.lit(0), F.size("dc_words") - size)).otherwise(F.array().cast("array<int>"))
    word = lambda i: F.get(F.col("dc_words"), i)
    return frame.withColumn(name, F.transform(starts, lambda i: F.xxhash64(*(word(i + k) for k in range(size))))).drop("dc_words")


def _spread() -> Column:
    """For every seven bits the number whose counters hold them."""
    return F.array(*(F.lit(sum(((bits >> lane) & 1) << (8 * lane) for lane in range(LANES))).cast("bigint") for bits in range(1 << LANES)))


def _shifted(value: Column, places: Column | int) -> Column:
    return F.call_function("shiftright", value, places if isinstance(places, Column) else F.lit(places))


def _fingerprint(sums: Column, count: Column) -> Column:
    """The number whose bits are those that more than half of the shingles set."""

    def ones(bit: Column) -> Column:
        number, places = F.floor(bit / LANES).cast("int"), (bit % LANES) * 8
        return F.aggregate(sums, F.lit(0).cast("bigint"), lambda total, part: total + _shifted(F.get(part, number), places).bitwiseAND(F.lit(255)))

    one = F.lit(1).cast("bigint")
    set_bit = lambda bit: F.when(ones(bit) * 2 > count, F.call_function("shiftleft", one, bit)).otherwise(F.lit(0).cast("bigint"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), set_bit)
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda total, bit: total + bit)


def _sums(shingles: Column) -> Column:
    """Packed counters of all bits of a stretch's hashes, added up in parts of 200 so that none overflows."""
    table, mask, zero = _spread(), F.lit((1 << LANES) - 1), F.array(*[F.lit(0).cast("bigint")] * NUMBERS)

    def voted(total: Column, shingle: Column) -> Column:
        return F.transform(total, lambda c, k: c + F.get(table, _shifted(shingle, k * LANES).bitwiseAND(mask).cast("int")))

    starts = F.sequence(F.lit(0), F.floor((F.size(shingles) - 1) / 200).cast("int"))
    return F.transform(starts, lambda i: F.aggregate(F.slice(shingles, i * 200 + 1, F.lit(200)), zero, voted))


def with_fingerprint(rows: DataFrame, shingles: str, name: str) -> DataFrame:
    """``rows`` with the SimHash of an array of shingle hashes (at least one).

    The counters pass through a generator: as a plain column they would be added up again for every bit.
    """
    frame = rows.select("*", F.explode(F.array(_sums(F.col(shingles)))).alias("dc_sums"))
    return frame.withColumn(name, _fingerprint(F.col("dc_sums"), F.size(shingles))).drop("dc_sums")


def _blocks(fingerprint: str, radius: int) -> Column:
    """(block, bits) of the fingerprint's blocks, as even as they can be."""
    count = min(radius + 1, BITS)
    edges = [BITS * k // count for k in range(count + 1)]
    cut = lambda low, high: F.shiftright(F.col(fingerprint), low).bitwiseAND(F.lit((1 << (high - low)) - 1))
    return F.array(*(F.struct(F.lit(k).alias("block"), cut(a, b).alias("bits")) for k, (a, b) in enumerate(zip(edges, edges[1:]))))


def benchmark_items(benchmark: DataFrame, settings: Settings) -> DataFrame:
    """(item_id, shingles, n) of the items long enough to be looked for."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("dc_text"))
    rows = with_shingles(rows, "dc_text", "shingles", settings.shingle).withColumn("n", F.size("shingles"))
    return rows.filter((F.col("n") > 0) & F.col("item_id").isNotNull())


def item_keys(items: DataFrame, settings: Settings) -> DataFrame:
    """(item_id, n, shingle): of each item its rarest shingles, one more than an alike stretch can miss.

    Shared shingles are at least ``percent`` of the item's, as all shingles are not fewer than these.
    """
    rows = items.select("item_id", "n", F.explode(F.array_distinct("shingles")).alias("shingle"))
    held = rows.groupBy("n", "shingle").agg(F.count("*").alias("held"))
    chosen = F.floor(F.col("n") * (100 - settings.percent) / 100) + 1
    sized = items.select("item_id", "n").distinct()
    rarest = rows.join(held, ["n", "shingle"]).groupBy("item_id", "n").agg(F.array_sort(F.collect_set(F.struct("held", "shingle"))).alias("order"))
    rarest = rarest.join(sized, ["item_id", "n"]).withColumn("order", F.slice("order", F.lit(1), chosen.cast("int")))
    return rarest.select("item_id", "n", F.explode("order.shingle").alias("shingle")).distinct()


def anchors(items: DataFrame, keys: DataFrame) -> DataFrame:
    """(shingle, n, key): the shingles of all items of n shingles, and whether one of these chose it."""
    rows = items.select("n", F.explode("shingles").alias("shingle"), F.lit(False).alias("key"))
    return rows.unionByName(keys.select("n", "shingle", F.lit(True).alias("key"))).groupBy("shingle", "n").agg(F.max("key").alias("key"))


def spans(hits: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, size, n, piece, spans, keys) from anchors (doc_id, size, n, place, key).

    The starts of a text are dealt into pieces of ``_grid`` of them. ``spans`` are the (low, high) of
    starts, high excluded, with anchors enough after them; ``keys`` the places of chosen shingles that
    a stretch from this piece can reach.
    """
    group, last = ["doc_id", "size", "n"], F.greatest(F.col("size") - F.col("n"), F.lit(0))
    hits = hits.groupBy(*group, "place").agg(F.max("key").alias("key"))
    step = lambda at, change: F.struct(at.alias("low"), F.lit(change).alias("change"))
    steps = F.array(step(F.greatest(F.col("place") - F.col("n") + 1, F.lit(0)), 1), step(F.col("place") + 1, -1))
    steps = hits.select(*group, F.inline(steps)).groupBy(*group, "low").agg(F.sum("change").alias("change"))
    ordered = Window.partitionBy(*group).orderBy("low")
    steps = steps.withColumns({"inside": F.sum("change").over(ordered), "high": F.lead("low").over(ordered)})
    # Shared shingles are anchors: with fewer of them no stretch is alike enough.
    enough = F.col("inside") * (100 + settings.percent) >= (F.col("n") + F.least("n", "size")) * settings.percent
    found = steps.filter(enough & (F.col("low") <= last)).withColumn("high", F.least(F.coalesce("high", last + 1), last + 1))
    grid = _grid(F.col("n"))
    piece = lambda at: F.floor(at / grid).cast("int")
    found = found.withColumn("piece", F.explode(F.sequence(piece(F.col("low")), piece(F.col("high") - 1))))
    low, high = F.greatest("low", F.col("piece") * grid), F.least("high", (F.col("piece") + 1) * grid)
    found = found.select(*group, "piece", F.struct(low.alias("low"), high.alias("high")).alias("span"), F.lit(None).cast("int").alias("place"))
    reached = F.array(piece(F.col("place")), piece(F.col("place")) - 1)
    reached = hits.filter("key").select(*group, F.explode(reached).alias("piece"), F.lit(None).cast(found.schema["span"].dataType).alias("span"), "place")
    pieces = found.unionByName(reached).groupBy(*group, "piece").agg(F.collect_list("span").alias("spans"), F.collect_list("place").alias("keys"))
    return pieces.filter((F.size("spans") > 0) & (F.size("keys") > 0))


def _grid(n: Column) -> Column:
    """Starts in a piece: not fewer than a stretch has shingles, so that a stretch reaches into two pieces at most."""
    return F.greatest(n, F.lit(GRID))


def _alike(left: Column, right: Column) -> tuple[Column, Column]:
    """Shared and all shingles of two stretches, by occurrence."""
    distinct = lambda array: F.size(F.array_distinct(array)) == F.size(array)
    times = lambda array, x: F.size(F.filter(array, lambda y: y == x))
    common = F.array_intersect(left, right)
    counted = F.aggregate(common, F.lit(0), lambda total, x: total + F.least(times(left, x), times(right, x)))
    both = F.when(distinct(left) | distinct(right), F.size(common)).otherwise(counted)
    return both, F.size(left) + F.size(right) - both


def matches(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, start, shared, total): alike stretches; ``start`` counts shingles."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "decontaminate")
    items = written(with_fingerprint(benchmark_items(benchmark, settings), "shingles", "fingerprint"), f"{folder}/items")
    keys = written(item_keys(items, settings), f"{folder}/keys")
    anchor = written(anchors(items, keys), f"{folder}/anchors")
    if anchor.count() <= BROADCAST_ANCHORS:
        anchor = F.broadcast(anchor)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("dc_text")).filter(F.col("doc_id").isNotNull())
    placed = with_shingles(rows, "dc_text", "shingles", settings.shingle)
    placed = placed.select("doc_id", F.size("shingles").alias("size"), F.posexplode_outer("shingles").alias("place", "shingle"))
    hits = written(placed.join(anchor, "shingle").select("doc_id", "size", "n", "place", "key"), f"{folder}/hits")
    pieces = spans(hits, settings).groupBy("doc_id", "size", "n").agg(F.collect_list(F.struct("piece", "spans", "keys")).alias("pieces"))
    pieces = written(pieces.groupBy("doc_id", "size").agg(F.collect_list(F.struct("n", "pieces")).alias("sizes")), f"{folder}/spans")
    # Only documents with such starts go on, and their shingles are made again; no row but one per
    # size of items carries all of them.
    # Both sides are dealt out by document at every size, as the pieces grow with the table.
    near = with_shingles(rows.join(pieces.hint("merge"), "doc_id"), "dc_text", "shingles", settings.shingle).filter(F.size("shingles") == F.col("size"))
    near = near.select("doc_id", "shingles", F.inline("sizes")).select("doc_id", "shingles", "n", F.inline("pieces"))
    first = F.col("piece") * _grid(F.col("n"))
    near = near.select("doc_id", "n", first.alias("first"), "spans", "keys", F.slice("shingles", first + 1, _grid(F.col("n")) + F.col("n") - 1).alias("part"))
    starts = F.flatten(F.transform("spans", lambda s: F.sequence(s["low"], s["high"] - 1)))
    near = near.withColumn("start", F.explode(starts))
    reached = F.filter("keys", lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("n")))
    chosen = F.array_distinct(F.transform(reached, lambda p: F.get(F.col("part"), p - F.col("first"))))
    near = near.select("doc_id", "n", "start", chosen.alias("keys"), F.slice("part", F.col("start") - F.col("first") + 1, F.col("n")).alias("stretch"))
    near = written(with_fingerprint(near.filter(F.size("keys") > 0), "stretch", "fingerprint"), f"{folder}/stretches")
    block = lambda rows: rows.select("*", F.explode(_blocks("fingerprint", settings.radius)).alias("b")).select("*", "b.block", "b.bits").drop("b")
    theirs = items.join(keys, ["item_id", "n"]).select("n", "shingle", "fingerprint").distinct()
    ours = near.select("n", F.explode("keys").alias("shingle"), "fingerprint").distinct()
    within = (
        block(ours)
        .join(block(theirs).withColumnRenamed("fingerprint", "item_fingerprint"), ["n", "shingle", "block", "bits"])
        .filter(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))) <= settings.radius)
        .select("n", "fingerprint", "item_fingerprint")
        .distinct()
    )
    within = written(within, f"{folder}/within")
    theirs = items.select("item_id", "n", "shingles", F.col("fingerprint").alias("item_fingerprint"))
    found = near.join(within, ["n", "fingerprint"]).join(theirs, ["n", "item_fingerprint"])
    both, total = _alike(F.col("stretch"), F.col("shingles"))
    return (
        found.select("doc_id", "item_id", "start", both.alias("shared"), total.alias("total"))
        .filter(F.col("shared") * 100 >= F.col("total") * settings.percent)
        .distinct()
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, items, similarity) of each contaminated document: its items, and the best match."""
    found = matches(docs, benchmark, settings)
    return found.groupBy("doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"),
        F.max(F.col("shared") / F.col("total")).alias("similarity"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    held = written(contaminated(docs, benchmark, settings).select(F.col("doc_id").alias("dc_id")), shared_dir(docs.sparkSession, "decontaminate-held"))
    return docs.join(held, docs["doc_id"].cast("bigint") == held["dc_id"], "left_anti")
