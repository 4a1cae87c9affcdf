"""MinHash near-duplicates: one-permutation hashing, banded buckets, star-shaped candidate links.

A document's set are its distinct word shingles (A-Z lower-cased; a shorter text is one shingle).
Texts with equal sets form a class, found by a 128-bit digest; everything below works on one member
of each class. One hash per shingle sorts it into one of ``bands * rows`` bins, each bin keeps its
smallest value, and empty bins are filled by optimal densification: bin i probes bins given by a
hash of (i, attempt) until it meets one that was not empty. ``rows`` bins make a band, equal bands
a bucket; with 40 bands of 6 rows two sets of similarity 0.8 share no bucket in 5 of a million cases.

In every bucket one member is the centre and is paired with the others, so a bucket of n gives
n - 1 pairs. Pairs are confirmed on the full sets. A centre is then done in its bucket. Buckets
whose members are not yet all connected go on with new centres, ``SPREAD`` times as many in each
round, chosen by hash; once at most ``SMALL`` members are left, all are centres. So no link is lost
to the star shape, and every bucket ends after a logarithmic number of rounds.

What is left after the first round are mostly copies changed a little too much, and comparing all of
them would take the square of their number. Their rare shingles (in at most ``RARE`` of these sets)
settle most without comparing: two sets that share no rare shingle have at most their other ones in
common, which bounds how alike they can be, so stars leave out pairs below the bound; pairs that do
share rare shingles are found by a join on these, whose rows grow with ``RARE`` and not with the group,
and are bounded by the number of rare shingles they share. Every pair is of one kind or the other.

Defined results: null and empty texts have no shingles and are linked with nothing, like rows
without an id. Rows that share an id are one document. Repeated rows and ties need no care: the
class digest and the smallest id decide. An empty table gives an empty result. Extra columns are
ignored by :func:`components` and carried by :func:`deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger.llm import text as words
from roadledger.llm.components import roots
from roadledger.session import shared_dir, written

# Buckets of so few members compare all of them in one round; the others have so many times more
# centres in each round.
SMALL = 32
SPREAD = 16
RARE = 50


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6

    @property
    def bins(self) -> int:
        return self.bands * self.rows


class SetMaker:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, size: int):
        self.size = size
        self.table = words.WordTable(words.hash64)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        flat, counts = self.table.lookup(map(words.lower_ascii, texts))
        hashes = self.table.rows[flat] if len(flat) else np.empty(0, np.uint64)
        ends = np.cumsum(counts)
        return [np.unique(words.shingle_hashes(hashes[e - n : e], self.size)) for e, n in zip(ends, counts)]


def probe(bins: np.ndarray, attempt: int, total: int) -> np.ndarray:
    """The bin that an empty bin looks at in its n-th attempt."""
    return (words.mix64(bins.astype(np.uint64) * np.uint64(0x100000) + np.uint64(attempt)) % np.uint64(total)).astype(np.int64)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of bin values per set; rows of empty sets are meaningless."""
    counts = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), bins), np.uint64)
    filled = np.zeros((len(sets), bins), bool)
    if counts.sum():
        flat = np.concatenate(sets)
        # Sets are sorted, so the bins (from the upper bits) ascend within each of them.
        at = (((flat >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
        cell = np.repeat(np.arange(len(sets)), counts) * bins + at
        first = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1])
        out.ravel()[cell[first]] = np.minimum.reduceat(words.mix64(flat), first)
        filled.ravel()[cell[first]] = True
    row, column = np.nonzero(~filled & (counts > 0)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        source = probe(column, attempt, bins)
        found = filled[row, source]
        out[row[found], column[found]] = out[row[found], source[found]]
        row, column = row[~found], column[~found]
    return out


def band_keys(signature: np.ndarray, settings: Settings) -> np.ndarray:
    cut = signature.reshape(len(signature), settings.bands, settings.rows)
    key = np.broadcast_to(words.mix64(np.arange(settings.bands)), cut.shape[:2])
    for row in range(settings.rows):
        key = words.pair64(key, cut[:, :, row])
    return key.view(np.int64)


def sketches(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, band keys) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = SetMaker(settings.shingle)
        for batch in batches:
            for part in words.slices(batch, "text"):
                sets = maker(part.column("text").to_pylist())
                keys = band_keys(signatures(sets, settings.bins), settings)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array(list(keys), pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "digest", "bands"],
                )

    return words.texts_of(docs).mapInArrow(words.releasing(run), "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>")


def _sets(docs: DataFrame, members: DataFrame, settings: Settings) -> DataFrame:
    """(node, shingles): the full sets of all members, hashes as bytes."""
    nodes = members.select(F.col("node").alias("doc_id")).distinct()
    needed = words.texts_of(docs).join(nodes, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = SetMaker(settings.shingle)
        for batch in batches:
            for part in words.slices(batch, "text"):
                sets = [s.tobytes() for s in maker(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return needed.mapInArrow(run, "node bigint, shingles binary")


def _confirmed(sets: DataFrame, pairs: DataFrame, settings: Settings) -> DataFrame:
    """(a, b, linked) of each pair of nodes, compared on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                left, right = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = len(np.intersect1d(left, right, assume_unique=True))
                linked.append(100 * both >= settings.percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint, linked boolean")


def _shingle_rows(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingle) of the nodes' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                flat = [np.frombuffer(x, np.int64) for x in part.column("shingles").to_pylist()]
                owner = np.repeat(np.arange(len(flat)), [len(x) for x in flat])
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(owner)), pa.array(np.concatenate(flat))], names=["node", "shingle"])

    return sets.join(nodes, "node", "left_semi").mapInArrow(run, "node bigint, shingle bigint")


def _rare_rows(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingle, held): the shingles that at most ``RARE`` of the nodes have, and how many do."""
    rows = _shingle_rows(sets, nodes)
    held = rows.groupBy("shingle").agg(F.count("*").alias("held")).filter(F.col("held") <= RARE)
    return rows.join(held, "shingle")


def _sharing_pairs(rare: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes not yet connected that share rare shingles, and enough to be alike.

    ``nodes``: node, size, rare (how many of its shingles are), root.
    """
    rows = rare.filter(F.col("held") > 1).join(nodes, "node").select("shingle", "node", "size", "rare", "root")
    left = rows.select("shingle", *(F.col(name).alias(f"a_{name}") for name in ("node", "size", "rare", "root")))
    right = rows.select("shingle", *(F.col(name).alias(f"b_{name}") for name in ("node", "size", "rare", "root")))
    both = left.join(right, "shingle").filter((F.col("a_node") < F.col("b_node")) & (F.col("a_root") != F.col("b_root")))
    keys = [f"{side}_{name}" for side in "ab" for name in ("node", "size", "rare")]
    pairs = both.groupBy(*keys).agg(F.count("*").alias("shared"))
    common = F.least(F.col("a_size") - F.col("a_rare"), F.col("b_size") - F.col("b_rare")) + F.col("shared")
    alike = common * 100 >= (F.col("a_size") + F.col("b_size") - common) * percent
    return pairs.filter(alike).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def _open_members(members: DataFrame) -> DataFrame:
    """Members of the buckets whose members are not all connected yet, with their number and the least of them."""
    buckets = (
        members.groupBy("bucket")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("held"), F.min("node").alias("first"))
        .filter(F.col("low") != F.col("high"))
        .select("bucket", "held", "first")
    )
    return members.join(buckets, "bucket")


def _central(seats: int) -> Column:
    """Is a member a centre of its bucket, in the round of about so many? All are where they are few.

    The members of low hashes are, and the least one. A member tells by itself, so those that go on
    are found without a join, and the same members are centres in all their buckets.
    """
    low = F.pmod(F.xxhash64("node", F.lit(seats)), F.lit(1 << 20)) * F.col("held") < F.lit((seats - 1) << 20)
    return (F.col("held") <= SMALL) | (F.col("node") == F.col("first")) | low


def _stars(members: DataFrame, seats: int, percent: int) -> DataFrame:
    """Pairs of the centres of every bucket with other members not yet connected.

    ``members``: bucket, held, first, node, size (of its set), rare, root (of its component so far).
    Pairs that share rare shingles are left to :func:`_sharing_pairs`; the others have at most their
    other shingles in common.
    """
    centres = members.filter(_central(seats)).select(
        "bucket", *(F.col(name).alias(f"c_{name}") for name in ("node", "size", "rare", "root"))
    )
    common = F.least(F.col("size") - F.col("rare"), F.col("c_size") - F.col("c_rare"))
    alike = common * 100 >= (F.col("size") + F.col("c_size") - common) * percent
    return (
        members.join(centres, "bucket")
        .filter((F.col("node") != F.col("c_node")) & (F.col("root") != F.col("c_root")) & alike)
        .select(F.least("node", "c_node").alias("a"), F.greatest("node", "c_node").alias("b"))
        .distinct()
    )


def components(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "minhash")
    sketch = written(sketches(docs, settings), f"{folder}/sketches")
    classes = (
        sketch.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
    )
    seats = classes.select(F.explode(F.array_distinct("bands")).alias("bucket"), "node", "size")
    crowded = seats.groupBy("bucket").agg(F.count("*").alias("held"), F.min("node").alias("first")).filter(F.col("held") > 1)
    members = seats.join(crowded, "bucket").withColumn("rare", F.lit(0).cast("bigint")).withColumn("root", F.col("node"))
    members = written(members, f"{folder}/members-1")
    sets = written(_sets(docs, members, settings), f"{folder}/sets")
    checked, root, rare, shared, round_number = None, None, None, None, 1

    def connect(pairs: DataFrame) -> None:
        """Confirm pairs and take the links into ``root``."""
        nonlocal checked, root
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = written(pairs, f"{folder}/pairs-{round_number}")
        if pairs.isEmpty():
            return
        checked = checked.unionByName(pairs) if checked is not None else pairs
        found = written(_confirmed(sets, pairs, settings), f"{folder}/confirmed-{round_number}").filter("linked").select("a", "b")
        if not found.isEmpty():
            if root is not None:
                found = found.unionByName(root.select(F.col("node").alias("a"), F.col("root").alias("b")))
            root = roots(found)

    def rooted(rows: DataFrame) -> DataFrame:
        """``rows`` (with node) and the node's root so far."""
        if root is None:
            return rows.withColumn("root", F.col("node"))
        return rows.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))

    while not members.isEmpty():
        seats = SPREAD ** (round_number - 1)
        pairs = _stars(members, seats, settings.percent)
        if shared is not None:  # settled along with the stars of the second round, not in a round of their own
            pairs, shared = pairs.unionByName(shared).distinct(), None
        connect(pairs)
        members = members.filter(~_central(seats)).select("bucket", "node", "size", "rare")
        members = rooted(members).select("bucket", "node", "size", "rare", "root")
        members = _open_members(written(members, f"{folder}/rooted-{round_number}"))  # read twice
        if round_number == 1:
            members = written(members, f"{folder}/open")
            left = members.select("node", "size").distinct()
            rare = written(_rare_rows(sets, left), f"{folder}/rare")
            counts = rare.groupBy("node").agg(F.count("*").alias("rare"))
            left = written(left.join(counts, "node", "left").fillna(0, ["rare"]), f"{folder}/left")
            # What nobody can be alike to without sharing rare shingles needs no star.
            enough = left.filter((F.col("size") - F.col("rare")) * 100 >= F.col("size") * settings.percent).select("node", "rare")
            members = _open_members(members.drop("rare", "held", "first").join(enough, "node").select("bucket", "node", "size", "rare", "root"))
            shared = _sharing_pairs(rare, rooted(left), settings.percent)
        round_number += 1
        members = written(members, f"{folder}/members-{round_number}")
    if shared is not None:
        connect(shared)
    first = classes.select("digest", "node")
    out = sketch.select("doc_id", "n_shingles", "digest").join(first, "digest", "left")
    if root is not None:
        out = out.join(root, "node", "left")
    else:
        out = out.withColumn("root", F.lit(None).cast("bigint"))
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(linked, F.coalesce("root", "node")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def deduplicated(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One document of each component, with all its columns; rows without an id stay.

    Rows that repeat an id are reduced to one.
    """
    gone = components(docs, settings).filter(~F.col("kept")).select("doc_id").distinct()
    gone = written(gone, shared_dir(docs.sparkSession, "minhash-gone"))
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    if repeated.isEmpty():
        return left
    one = left.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return one.unionByName(left.filter(F.col("doc_id").isNull()))
