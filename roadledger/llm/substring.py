"""Substring dedup: repeated runs of words, found by recompression.

A window is ``window`` consecutive words of one document. Words covered by a window whose word
sequence also starts earlier (in a smaller id, or earlier in the same document) are removed; all
windows are judged on the input.

Candidates come from recompression: in each round runs of equal symbols, then pairs of a left and
a right symbol (the side is a bit of the symbol's hash), are replaced by new symbols. A new symbol's
name is a hash of what it stands for, so it is the same name in all documents and rounds need no
exchange. Whether two symbols join depends on these two only, and how far a run reaches on its own
symbols only; so all that lies inside a window, apart from what touches its ends, is named alike
wherever the window stands. Of those symbols the one that covers most words (then the largest hash)
is the window's mark. Equal windows have equal marks, and neighbouring windows mostly share one,
so Spark counts marks instead of windows: about one row for eight words. Only windows whose mark
occurs again are compared themselves, by an 80-bit digest, and the smallest id per digest is
where the sequence starts first. Texts equal to one with a smaller id are found beforehand by a
128-bit digest; all their windows start earlier, so they need no marks.

Defined results: null and empty texts have no words; texts shorter than a window lose none; rows
without an id are neither compared nor changed. Rows that share an id are one document, so what
they have in common with each other stays. An empty table gives an empty result. Extra columns are
ignored by :func:`removals` and :func:`kept_texts`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadledger.llm import text as words
from roadledger.session import shared_dir, written

WINDOW = 20
ROUNDS = 2
_RIGHT = np.uint64(63)


class Symbols:
    """One level of a parse: names, and first word, number of words and text of each symbol."""

    def __init__(self, names: np.ndarray, first: np.ndarray, spans: np.ndarray, docs: np.ndarray):
        self.names, self.first, self.spans, self.docs = names, first, spans, docs

    def join(self, starts: np.ndarray, names: np.ndarray) -> Symbols:
        return Symbols(names, self.first[starts], np.add.reduceat(self.spans, starts), self.docs[starts])

    def best(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of many ranges of symbols (both ends included) the one that covers most words, then has
        the largest hash, then stands first: its mark and its first word."""
        marks = (np.minimum(self.spans, 255).astype(np.uint64) << np.uint64(56)) | (words.mix64(self.names) >> np.uint64(8))
        width = high - low + 1
        table, chosen, size = np.arange(len(marks)), np.zeros(len(low), np.int64), 1
        better = lambda a, b: np.where(marks[b] > marks[a], b, a)
        while len(width):
            fits = (width >= size) & (width < 2 * size)
            if fits.any():
                chosen[fits] = better(table[low[fits]], table[high[fits] - size + 1])
            size *= 2
            if size > width.max():
                break
            table = better(table[: -size // 2], table[size // 2 :])
        return marks[chosen], self.first[chosen]


def _runs(level: Symbols) -> tuple[Symbols, np.ndarray]:
    """Replace runs of equal symbols; also the number of the run each symbol went to."""
    fresh = np.ones(len(level.names), bool)
    fresh[1:] = (level.names[1:] != level.names[:-1]) | (level.docs[1:] != level.docs[:-1])
    starts = np.flatnonzero(fresh)
    length = np.diff(starts, append=len(fresh)).astype(np.uint64)
    names = level.names[starts]
    names = np.where(length > 1, words.pair64(names, length), names)
    return level.join(starts, names), np.cumsum(fresh) - 1


def _pairs(level: Symbols, turn: int) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """Replace left-right pairs; also each symbol's side and the number of the symbol it went to."""
    right = (words.mix64(level.names + np.uint64(turn)) >> _RIGHT).astype(bool)
    joins = np.zeros(len(right), bool)
    joins[:-1] = ~right[:-1] & right[1:] & (level.docs[:-1] == level.docs[1:])
    fresh = np.ones(len(right), bool)
    fresh[1:] = ~joins[:-1]
    starts = np.flatnonzero(fresh)
    names = level.names[starts]
    first = joins[starts]
    names[first] = words.pair64(names[first], level.names[starts[first] + 1])
    return level.join(starts, names), right, np.cumsum(fresh) - 1


def window_marks(
    names: np.ndarray, counts: np.ndarray, window: int, rounds: int = ROUNDS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words (positions in ``names``) of all windows, the windows' marks and where these stand.

    ``names`` are the word hashes of texts laid end to end, ``counts`` the words of each text.
    """
    docs = np.repeat(np.arange(len(counts)), counts)
    ends = np.repeat(np.cumsum(counts), counts)
    begin = np.flatnonzero(np.arange(len(names)) + window <= ends)
    marks, places = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.int64)
    level = Symbols(names, np.arange(len(names)), np.ones(len(names), np.int64), docs)
    open_, low, high = np.arange(len(begin)), begin, begin + window - 1

    def settle(new_low: np.ndarray, new_high: np.ndarray):
        """Windows with nothing left inside take their mark from the level before."""
        done = new_low > new_high
        if done.any():
            marks[open_[done]], places[open_[done]] = level.best(low[done], high[done])
        return open_[~done], new_low[~done], new_high[~done]

    for turn in range(rounds):
        if not len(open_):
            break
        runs, to = _runs(level)
        open_, low, high = settle(to[low] + 1, to[high] - 1)
        level = runs
        pairs, right, to = _pairs(level, turn)
        open_, low, high = settle(low + right[low], high - ~right[high])
        level, low, high = pairs, to[low], to[high]
    marks[open_], places[open_] = level.best(low, high)
    return begin, marks, places


def _digests(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """80 bits for every window of the words, in two parts that depend on the words differently."""
    if len(hashes) < window:
        return np.empty(0, np.int64), np.empty(0, np.int16)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words.mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
    first = words.shingle_hashes(hashes, window).view(np.int64)
    return first, ((sums[window:] - sums[:-window]) >> np.uint64(48)).astype(np.uint16).view(np.int16)


def _mark_rows(docs: DataFrame, window: int) -> DataFrame:
    """(mark, doc_id, first, windows): stretches of neighbouring windows that share one place's mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words.WordTable(words.hash64)
        for batch in batches:
            for part in words.slices(batch, "text"):
                flat, counts = table.lookup(part.column("text").to_pylist())
                if not len(flat):
                    continue
                begin, marks, places = window_marks(table.rows[flat], counts, window)
                owner = np.repeat(np.arange(len(counts)), counts)[begin]
                fresh = np.ones(len(begin), bool)
                fresh[1:] = (places[1:] != places[:-1]) | (marks[1:] != marks[:-1])
                starts = np.flatnonzero(fresh)
                first = begin[starts] - (np.cumsum(counts) - counts)[owner[starts]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(marks[starts].view(np.int64)),
                        part.column("doc_id").take(pa.array(owner[starts])),
                        pa.array(first.astype(np.int32)),
                        pa.array(np.diff(starts, append=len(begin)).astype(np.int32)),
                    ],
                    names=["mark", "doc_id", "first", "windows"],
                )

    return docs.mapInArrow(run, "mark bigint, doc_id bigint, first int, windows int")


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Elements of all lists, one list after the other, and the number of the list each is from."""
    length = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), np.int64)
    return lists.flatten(), np.repeat(np.arange(len(lists)), length)


def _candidates(part: pa.RecordBatch, window: int, table: words.WordTable) -> tuple[np.ndarray, ...]:
    """Words per text; of all candidate windows, by text and place: the text's number, the first word (of the
    texts laid end to end) and the two digests. Texts without stretches count as having no words."""
    stretches = part.column("stretches")
    wanted = stretches.is_valid()
    counts = np.zeros(len(part), np.int64)
    flat, counts[np.asarray(wanted)] = table.lookup(part.column("text").filter(wanted).to_pylist())
    found, owner = _flat(stretches)
    first, length = (np.asarray(found.field(k), np.int64) for k in range(2))
    begin = (np.cumsum(counts) - counts)[owner] + first
    # Rows that share an id also share stretches; another text may be too short for them.
    length = np.minimum(length, counts[owner] - window + 1 - first)
    begin, length = begin[length > 0], length[length > 0]
    chosen = np.zeros(len(flat) + 1, np.int64)
    np.add.at(chosen, begin, 1)
    np.add.at(chosen, begin + length, -1)
    at = np.flatnonzero(np.cumsum(chosen) > 0)
    one, two = _digests(table.rows[flat], window) if len(at) else _digests(np.empty(0, np.uint64), window)
    return counts, np.repeat(np.arange(len(counts)), counts)[at], at, one[at], two[at]


_STRETCHES = "array<struct<first:int,windows:int>>"


def _copies(texts: DataFrame) -> DataFrame:
    """(doc_id) of the documents whose text a smaller id has too."""
    known = texts.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    digests = known.select("doc_id", F.xxhash64("text").alias("one"), F.xxhash64(F.lit(1), "text").alias("two"))
    shared = digests.groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter(F.col("n") > 1)
    found = digests.join(shared.drop("n"), ["one", "two"], "left").groupBy("doc_id")
    # An id with several texts is a copy only if all of them are.
    return found.agg(F.max(F.coalesce("first", "doc_id")).alias("first")).filter(F.col("first") < F.col("doc_id")).select("doc_id")


def _judged(docs: DataFrame, window: int) -> DataFrame:
    """Every row of (doc_id, text, stretches, copy, firsts): the candidate stretches of the text, whether it
    is a copy, and the digests of the windows that start first in it."""
    spark = docs.sparkSession
    texts = words.texts_of(docs)
    copies = written(_copies(texts), shared_dir(spark, "substring-copies"))
    # Made once and read twice, for the counts and for the join: counts are added up before their shuffle.
    rows = _mark_rows(texts.filter(F.col("doc_id").isNotNull()).join(copies, "doc_id", "left_anti"), window)
    rows = written(rows, shared_dir(spark, "substring-marks"))
    again = rows.groupBy("mark").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("mark")
    stretches = (
        rows.join(again, "mark")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("first", "windows")).alias("stretches"))
        .withColumn("copy", F.lit(False))
    )
    whole = copies.select("doc_id", F.lit(None).cast(_STRETCHES).alias("stretches"), F.lit(True).alias("copy"))
    stretches = written(stretches.unionByName(whole), shared_dir(spark, "substring-stretches"))
    # Read twice below, and shuffled once: neither reader filters it or leaves out a column.
    marked = texts.join(stretches, "doc_id", "left")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words.WordTable(words.hash64)
        for batch in batches:
            for part in words.slices(batch, "text"):
                _, owner, at, one, two = _candidates(part, window, table)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one), pa.array(two), part.column("doc_id").take(pa.array(owner))], names=["one", "two", "doc_id"]
                    )

    firsts = (
        marked.mapInArrow(digests, "one bigint, two smallint, doc_id bigint")
        .groupBy("one", "two")
        .agg(F.min("doc_id").alias("doc_id"))
        .groupBy("doc_id")
        .agg(F.collect_list("one").alias("firsts"))
    )
    return marked.join(firsts, "doc_id", "left")


def _removed(part: pa.RecordBatch, window: int, table: words.WordTable) -> pa.ListArray:
    """Per text the ranges of words covered by windows that start earlier elsewhere or in the same text."""
    counts, owner, at, one, _ = _candidates(part, window, table)
    own, of = _flat(part.column("firsts"))
    # Equal windows of a text stand together, behind the digest that says they start first in it; places ascend.
    digest = np.concatenate([np.asarray(own, np.int64), one])
    number, here = np.concatenate([of, owner]), np.repeat([False, True], [len(of), len(at)])
    order = np.lexsort((digest, number))
    digest, number, here = digest[order], number[order], here[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (digest[1:] != digest[:-1]) | (number[1:] != number[:-1])
    # Of a group, the first window behind one of the text's own digests stays.
    stays = np.zeros(len(order), bool)
    stays[1:] = here[1:] & ~here[:-1] & ~fresh[1:]
    late = at[order[here & ~stays] - len(of)]
    total = int(counts.sum())
    cover = np.bincount(late, minlength=total + 1) - np.bincount(late + window, minlength=total + 1)
    gone = np.cumsum(cover[:total]) > 0
    begins = np.zeros(total + 1, bool)
    begins[np.cumsum(counts) - counts] = True  # a range ends with its text
    before = np.concatenate([[False], gone[:-1]]) if total else gone
    start = np.flatnonzero(gone & (~before | begins[:total]))
    end = np.flatnonzero(gone & ~(np.concatenate([gone[1:], [False]]) & ~begins[1:])) + 1 if total else start
    text = np.repeat(np.arange(len(counts)), counts)[start]
    base, size = np.cumsum(counts) - counts, np.bincount(text, minlength=len(counts))
    ranges = [(start - base[text]).astype(np.int32), (end - base[text]).astype(np.int32)]
    # Of a copy all words go.
    copy = np.asarray(pa.compute.fill_null(part.column("copy"), False))
    for k in np.flatnonzero(copy).tolist():
        n = len(words.words_of(part.column("text")[k].as_py()))
        if n >= window:
            place = int(size[:k].sum())
            ranges = [np.insert(ranges[0], place, 0), np.insert(ranges[1], place, n)]
            size[k] = 1
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(r) for r in ranges], names=["start", "end"]))


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, removed) of every row: ``removed`` are half-open ranges of word numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words.WordTable(words.hash64)
        for batch in batches:
            for part in words.slices(batch, "text"):
                columns = [part.column("doc_id"), part.column("text"), _removed(part, window, table)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "removed"])

    return _judged(docs, window).mapInArrow(run, "doc_id bigint, text string, removed array<struct<start:int,end:int>>")


def kept_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` are the words that stay, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words.WordTable(words.hash64)
        for batch in batches:
            for part in words.slices(batch, "text"):
                ranges, text_of = _flat(_removed(part, window, table))
                start, end = (np.asarray(ranges.field(k), np.int64) for k in range(2))
                last = np.searchsorted(text_of, np.arange(len(part) + 1)).tolist()
                n_words, kept = [], []
                for number, text in enumerate(part.column("text").to_pylist()):
                    found = words.words_of(text)
                    n_words.append(len(found))
                    for k in range(last[number + 1] - 1, last[number] - 1, -1):
                        del found[start[k] : end[k]]
                    kept.append(b" ".join(found))
                n_removed = np.bincount(text_of, weights=end - start, minlength=len(part)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    return _judged(docs, window).mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
