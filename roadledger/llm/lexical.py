"""Ranked lexical search by bag deduplication.

A query item sees of a document only the words of its own vocabulary. Documents are therefore cut
to the items' vocabulary, and those with the same term frequencies and the same length factor m
form a class: classes are found by hash and verified by comparing the bags themselves. Each class
is scored once per item, and only classes that can be in an item's result are expanded to their
members, by ascending id. If a document is among the best k by (score, id), its class is among the
best k classes by (score, smallest id), so k classes with k members each are enough.

All documents are counted, looked up and scored. Items are handled in blocks of a bounded number of
terms, each block against all documents: it is the table of items that is sent to the tasks, never
documents. A task keeps k classes per item. Bags, classes and members stay in written tables; of a
class with very many members each task passes on its k smallest ids, so a third of all rows in one
class is no more than k rows per task. Texts are read in stretches of bounded size.

Defined results: terms are maximal runs of characters other than ASCII control characters, space
and punctuation, A-Z lower-cased; null and empty texts have none. Documents without an id count in
the statistics and are never returned; repeated rows are documents of their own. Rows of one item
id that differ are one item with the terms of all; repeated ones count once, items without an id
are left out. Items or tables without terms give no rows. Only ids and texts are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadledger.llm.text import slices, texts_of
from roadledger.session import shared_dir, written

STRETCH = 1 << 22
# Classes scored together: cells (classes by items) and products (one per term of class and item).
CELLS = 1 << 21
PRODUCTS = 1 << 20
# Candidates kept by a task before it drops those that can no longer be among the best.
HELD = 1 << 20


def _cleaning() -> bytes:
    """Upper to lower case, everything else of ASCII but letters and digits to a space."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for code in (*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)):
        table[code] = code
    for code in range(ord("A"), ord("Z") + 1):
        table[code] = code + 32
    return bytes(table)


CLEANING = _cleaning()


@dataclass(frozen=True)
class Settings:
    """``best`` documents per item; ``block_terms`` distinct terms of items sent to a task at a time."""

    best: int = 20
    block_terms: int = 500_000


def terms_of(text: str | None, stretch: int = STRETCH) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded length: a long text is cut where terms are cut."""
    raw = text.encode("utf-8", "surrogatepass").translate(CLEANING) if text else b""
    begin = 0
    while begin < len(raw):
        end = raw.find(b" ", begin + stretch)
        end = len(raw) if end < 0 else end
        yield raw[begin:end].split()
        begin = end


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for item, text in zip(part.column("item_id").to_pylist(), part.column("text").to_pylist()):
                    counts: Counter[bytes] = Counter()
                    for terms in terms_of(text):
                        counts.update(terms)
                    rows += [(item, term, times) for term, times in counts.items()]
                columns = list(zip(*rows)) or [(), (), ()]
                kinds = (pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item_id", "term", "times"])

    known = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    known = known.filter(F.col("item_id").isNotNull()).distinct()
    found = known.mapInArrow(run, "item_id bigint, term binary, times bigint")
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def bags(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, length, terms, times) of every row: its number of terms, and places in the
    vocabulary (ascending) with their frequencies."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = {term: place for place, term in enumerate(shared.value)}.get
        for batch in batches:
            for part in slices(batch, "text"):
                lengths, sizes, places, times = [], [0], [], []
                for text in part.column("text").to_pylist():
                    length, counts = 0, Counter()
                    for terms in terms_of(text):
                        length += len(terms)
                        counts.update(map(get, terms))
                    counts.pop(None, None)
                    lengths.append(length)
                    sizes.append(sizes[-1] + len(counts))
                    for place in sorted(counts):
                        places.append(place)
                        times.append(counts[place])
                ends = pa.array(sizes, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(lengths, pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(places, pa.int32())),
                        pa.ListArray.from_arrays(ends, pa.array(times, pa.int64())),
                    ],
                    names=["doc_id", "length", "terms", "times"],
                )

    return texts_of(docs).mapInArrow(run, "doc_id bigint, length bigint, terms array<int>, times array<bigint>")


def classes(found: DataFrame, documents: int, total: int, best: int) -> DataFrame:
    """(members, terms, times, m): documents with the same bag and the same m.

    ``members`` are the ``best`` smallest ids, ascending. The hash brings equal bags together, the
    comparison of the bags decides.
    """
    bag = ["hash", "terms", "times", "m"]
    m = F.lit(75).cast("bigint") + F.call_function("div", F.lit(25).cast("bigint") * F.col("length") * F.lit(documents).cast("bigint"), F.lit(max(total, 1)).cast("bigint"))
    keyed = (
        found.filter(F.col("doc_id").isNotNull() & (F.size("terms") > 0))
        .select("doc_id", "terms", "times", m.alias("m"))
        .select("*", F.xxhash64("terms", "times", "m").alias("hash"))
    )
    place = F.row_number().over(Window.partitionBy(*bag).orderBy("doc_id"))
    first = keyed.withColumn("place", place).filter(F.col("place") <= best)
    return first.groupBy(*bag).agg(F.sort_array(F.collect_list("doc_id")).alias("members")).drop("hash")


@dataclass
class Block:
    """A block of items: for each place of the vocabulary the items that have the term.

    Row ``k`` of the vocabulary owns ``owners[starts[k]:starts[k + 1]]`` (places in ``items``), and
    ``factors`` are the term's weight times its frequency in the item.
    """

    items: np.ndarray
    starts: np.ndarray
    owners: np.ndarray
    factors: np.ndarray


def _scores(block: Block, owner: np.ndarray, terms: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Scores (rows by items) of classes whose terms are (owner row, term, value)."""
    counts = block.starts[terms + 1] - block.starts[terms]
    place = np.repeat(block.starts[terms] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    scores = np.zeros(rows * len(block.items), np.int64)
    cells = np.repeat(owner * len(block.items), counts) + block.owners[place]
    np.add.at(scores, cells, block.factors[place] * np.repeat(values, counts))
    return scores.reshape(rows, len(block.items))


class _Best:
    """The best classes per item seen so far: by score, then by the smaller first member."""

    def __init__(self, items: int, best: int):
        self.best = best
        self.least = np.ones(items, np.int64)  # a lower score cannot be among the best
        self.held: list[tuple[np.ndarray, ...]] = []
        self.members: dict[int, list[int]] = {}
        self.size = self.seen = 0

    def add(self, scores: np.ndarray, members: list[list[int]]) -> None:
        row, item = np.nonzero(scores >= self.least)
        first = np.array([ids[0] for ids in members], np.int64)
        self.held.append((item, scores[row, item], first[row], row + self.seen))
        self.members.update((int(r) + self.seen, members[r]) for r in np.unique(row))
        self.seen += len(members)
        self.size += len(row)
        if self.size > HELD or len(self.members) > HELD // self.best:
            self.prune()

    def prune(self) -> tuple[np.ndarray, ...]:
        """(item, score, first member, number of the class), by item and then from the best on."""
        item, score, first, number = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((number, first, -score, item))
        ranked = item[order]
        rank = np.arange(len(order)) - np.searchsorted(ranked, ranked)
        kept = order[rank < self.best]
        last = order[rank == self.best - 1]
        self.least[item[last]] = score[last]
        self.held, self.size = [(item[kept], score[kept], first[kept], number[kept])], len(kept)
        self.members = {int(n): self.members[int(n)] for n in np.unique(number[kept])}
        return self.held[0]


def _parts(block: Block, owner: np.ndarray, terms: np.ndarray, rows: int) -> list[tuple[int, int]]:
    """Cuts a batch of classes so that neither cells nor products of a part get many."""
    counts = np.bincount(owner, weights=block.starts[terms + 1] - block.starts[terms], minlength=rows)
    by_products = (np.cumsum(counts) // PRODUCTS).astype(np.int64)
    by_cells = np.arange(rows) // max(1, CELLS // max(1, len(block.items)))
    edges = np.flatnonzero((np.diff(by_products) != 0) | (np.diff(by_cells) != 0)) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), rows]))


def scored(grouped: DataFrame, block: Block, best: int) -> DataFrame:
    """(item_id, score, members): per task the best classes of each item."""
    shared = grouped.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        found = _Best(len(block.items), best)
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.concatenate([[0], np.cumsum(np.diff(batch.column("terms").offsets.to_numpy()))])
            owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            terms = batch.column("terms").flatten().to_numpy().astype(np.int64)
            times, members = batch.column("times").flatten().to_numpy(), batch.column("members").to_pylist()
            values = (1_000_000_000 * times) // (1000 * times + 12 * batch.column("m").to_numpy()[owner])
            for begin, end in _parts(block, owner, terms, batch.num_rows):
                here = slice(ends[begin], ends[end])
                found.add(_scores(block, owner[here] - begin, terms[here], values[here], end - begin), members[begin:end])
        if found.held:
            item, score, _, number = found.prune()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.items[item]),
                    pa.array(score),
                    pa.array([found.members[int(n)] for n in number], pa.list_(pa.int64())),
                ],
                names=["item_id", "score", "members"],
            )

    return grouped.select("members", "terms", "times", "m").mapInArrow(run, "item_id bigint, score bigint, members array<bigint>")


def _search_block(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    spark = docs.sparkSession
    folder = shared_dir(spark, "lexical")
    rows = wanted.toArrow()  # a block of items, bounded by block_terms
    vocabulary = sorted(set(rows.column("term").to_pylist()))
    found = written(bags(docs, vocabulary), f"{folder}/bags")
    documents, total = found.agg(F.count_if(F.col("length") > 0), F.sum("length")).first()
    counts = found.select(F.explode("terms").alias("place")).groupBy("place").count()
    held = np.zeros(len(vocabulary), np.int64)
    for place, count in counts.collect():  # one row per term of the block
        held[place] = count
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in held], np.int64)
    place_of = {term: k for k, term in enumerate(vocabulary)}
    places = np.array([place_of[term] for term in rows.column("term").to_pylist()], np.int64)
    items, owners = np.unique(rows.column("item_id").to_numpy(), return_inverse=True)
    order = np.argsort(places, kind="stable")
    block = Block(
        items,
        np.searchsorted(places[order], np.arange(len(vocabulary) + 1)),
        owners[order],
        (weights[places] * rows.column("times").to_numpy())[order],
    )
    grouped = written(classes(found, documents, total or 0, settings.best), f"{folder}/classes")
    top = scored(grouped, block, settings.best)
    by_class = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("members")[0])
    kept = top.withColumn("place", F.row_number().over(by_class)).filter(F.col("place") <= settings.best)
    expanded = kept.select("item_id", "score", F.explode("members").alias("doc_id"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return expanded.withColumn("rank", rank).filter(F.col("rank") <= settings.best).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents with a score above 0."""
    spark = docs.sparkSession
    wanted = written(_item_terms(items), shared_dir(spark, "lexical-items"))
    blocks = max(1, math.ceil(wanted.count() / settings.block_terms))
    block_of = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    result = None
    for number in range(blocks):
        part = _search_block(docs, wanted.filter(block_of == number), settings)
        result = part if result is None else result.unionByName(part)
    return result
