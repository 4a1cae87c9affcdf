"""Packing in space-filling-curve order.

Every document is tokenised whole and ended by one id. Its words, hashed into buckets, make a
document vector that a fixed random matrix projects to a few dimensions; the Hilbert curve through
that space gives a sort key, so documents with alike words are neighbours on the curve. Documents
are laid end to end in the order of (key, id) and cut every ``length`` tokens. No sequence but
the last needs padding.

The order is found on rows without texts: range partitions, sorted, with running sums inside each
and one sum per partition on the driver. Equal keys are told apart by the id, so a crowd of equal
texts is spread over partitions too. Tokens are made once, written to shared storage, and joined
with their places by row number.

Defined results: null and empty texts are the end id alone; rows with null ids or repeated rows are
packed one by one, in the order in which they were read; an empty table gives no pieces; extra
columns are ignored.
"""

from __future__ import annotations

import json
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roadledger.llm import text as words
from roadledger.session import shared_dir, written

# A word cache beyond this size keeps its repeated words, ``KEPT_WORDS`` at most.
CACHE_WORDS = 400_000
KEPT_WORDS = 200_000

# A control character: neither white space nor letter, so a token by itself between spaces.
MARK, TOGETHER = "\x1f", 256
ENDS = string.punctuation.encode()

# Words of these letters alone can go straight to the tokenizer's model.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + re.sub("[\xd7\xf7]", "", "".join(map(chr, range(0xC0, 0x100))))
PLAIN = re.compile(f"[{LETTERS}]+").fullmatch
# Words of so many bytes of text are told apart at once; more text has fewer distinct words for each, and needs more memory.
TEXT_CHARS = words.SLICE_CHARS


def stems_and_ends(new: list[bytes], lowered: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """The words with A-Z lower-cased, and the punctuation that ends them.

    The tokenizer lower-cases too, and it cuts between a letter or digit and punctuation, so the
    ids of the two parts are the ids of the word. Letters beyond ASCII are told for U+00C0 to U+00FF.
    """
    stems, ends = [word.rstrip(ENDS) for word in lowered], [b""] * len(new)
    cut = np.flatnonzero(np.fromiter(map(len, stems), np.int64, len(new)) != np.fromiter(map(len, lowered), np.int64, len(new)))
    for k in cut.tolist():
        stem, word = stems[k], lowered[k]
        if stem[-1:].isalnum() or (stem[-2:-1] == b"\xc3" and stem[-1:] not in (b"\x97", b"\xb7")):
            ends[k] = word[len(stem) :]
        else:
            stems[k] = word
    for k in [k for k, word in enumerate(new) if b"<|" in word]:
        stems[k], ends[k] = new[k], b""
    return stems, ends


@dataclass(frozen=True)
class Settings:
    tokenizer: str
    length: int = 4096
    end_id: int = 2
    dimensions: int = 3
    bits: int = 10
    buckets: int = 1024
    seed: int = 5


class Coded:
    """The ids of each word of the cache, in one array, behind the end id."""

    def __init__(self, kind: np.dtype, end_id: int):
        self.pool, self.start, self.size = np.array([end_id], kind), np.empty(0, np.int64), np.empty(0, np.int32)

    def __len__(self) -> int:
        return len(self.size)

    def extend(self, coded: list[bytes]) -> None:
        size = np.fromiter(map(len, coded), np.int32, len(coded)) // self.pool.itemsize
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size, dtype=np.int64) - size])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(coded), self.pool.dtype)])
        self.size = np.concatenate([self.size, size])

    def take(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ids of many places, one place after the other."""
        ends = np.cumsum(size, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        narrow = np.int32 if max(total, len(self.pool)) < 1 << 31 else np.int64
        at = np.arange(total, dtype=narrow)
        at += np.repeat((start - (ends - size)).astype(narrow), size)
        return self.pool.take(at)

    def keep(self, mask: np.ndarray) -> None:
        start, self.size = self.start[mask], self.size[mask]
        self.pool = np.concatenate([self.pool[:1], self.take(start, self.size)])
        self.start = 1 + np.cumsum(self.size, dtype=np.int64) - self.size


class Encoder:
    """Token ids and projected vectors of texts, put together from those of their words.

    The tokenizer drops white space before anything else, so a text's ids are its words' ids. This
    and :func:`stems_and_ends` hold for lower-casing tokenizers that cut between white space, letters
    and punctuation.
    """

    def __init__(self, tokenizer: str, settings: Settings):
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind = np.dtype("<u4") if self.wide else np.dtype("<u2")
        self.settings = settings
        rng = np.random.default_rng(settings.seed)
        self.matrix = rng.standard_normal((settings.buckets, settings.dimensions)).astype(np.float32)
        self.coded = Coded(self.kind, settings.end_id)
        self.table, self.uses = words.DigestTable(self._features, CACHE_WORDS), np.zeros(0, np.int64)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.ends_word = self._word_ends(tokenizer)
        self.spelling = self._letters()

    def _word_ends(self, tokenizer: str) -> np.ndarray | None:
        """For each id whether it ends a word, where the vocabulary says so (by a suffix of its own)."""
        suffix = json.loads(tokenizer)["model"].get("end_of_word_suffix")
        if not suffix:
            return None
        ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            ends[number] = token.endswith(suffix)
        return ends

    def _letters(self) -> dict[int, str] | None:
        """What the tokenizer makes of each of ``LETTERS`` before its model sees it.

        None if it makes something else of letters next to each other, or cuts words of them: then
        such words need the whole tokenizer.
        """
        normalizer, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if normalizer is None or cutter is None:
            return None
        pieces = lambda text: [piece for piece, _ in cutter.pre_tokenize_str(normalizer.normalize_str(text))]
        spelling = {ord(letter): "".join(pieces(letter)) for letter in LETTERS}
        for text in (LETTERS, LETTERS[::-1], *(LETTERS[k::7] for k in range(7))):
            spelt = text.translate(spelling)
            whole = self.tokenizer.encode(text, add_special_tokens=False).ids
            if pieces(text) != [spelt] or whole != [token.id for token in self.tokenizer.model.tokenize(spelt)]:
                return None
        return spelling if LETTERS[:26].translate(spelling) == LETTERS[:26] else None

    def _features(self, new: list[bytes]) -> np.ndarray:
        lowered = b" ".join(new).lower().split(b" ")
        stems, ends = stems_and_ends(new, lowered)
        known = self._encode([x for x in dict.fromkeys(stems + ends) if x])
        self.coded.extend([known[stem] + known[end] if end else known[stem] for stem, end in zip(stems, ends)])
        # Long words say more about a text than short ones.
        weight = np.minimum([len(w) for w in new], 12).astype(np.float32)
        bucket = words.hash64(lowered) % np.uint64(self.settings.buckets)
        return np.column_stack([self.matrix[bucket.astype(np.int64)] * weight[:, None], weight])

    def _encode(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words without white space.

        Words of ``LETTERS`` are spelt as the model wants them and need neither the tokenizer's normalizer
        nor its patterns. Of the others, many are handed over as one text; the rest go alone.

        Where ids tell the end of a word, words of letters only need nothing but a space between them:
        each is cut off as one piece. Others get a mark that is a token of its own behind them, unless
        they hold it themselves.
        """
        out = self._spelt(new)
        new = [word for word in new if word not in out]
        texts = [word.decode("utf-8", "replace") for word in new]
        by_end = [k for k, text in enumerate(texts) if text.isalpha()] if self.ends_word is not None else []
        known = set(by_end)
        by_mark = [k for k, text in enumerate(texts) if k not in known and MARK not in text] if len(self.mark) == 1 else []
        known.update(by_mark)
        alone = [k for k in range(len(texts)) if k not in known]
        for places, mark in ((by_end, ""), (by_mark, f" {MARK}")):
            for begin in range(0, len(places), TOGETHER):
                some = places[begin : begin + TOGETHER]
                joined = "".join(f"{texts[k]}{mark} " for k in some)
                ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
                ends = np.flatnonzero(ids == self.mark[0] if mark else self.ends_word[ids]) + (0 if mark else 1)
                if len(ends) != len(some):  # not as expected (a word of the mark's token, letters unknown to the tokenizer)
                    alone.extend(some)
                    continue
                raw, size, skip = ids.astype(self.kind).tobytes(), self.kind.itemsize, len(mark) // 2
                start = 0
                for k, end in zip(some, ends.tolist()):
                    out[new[k]] = raw[start * size : end * size]
                    start = end + skip
        for k in alone:
            out[new[k]] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, self.kind).tobytes()
        return out

    def _spelt(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of those of the words that are made of ``LETTERS`` only."""
        found: list[bytes] = []
        ids: list[int] = []
        ends = [0]
        tokenize, spelling = self.tokenizer.model.tokenize, self.spelling
        for word in new if spelling else ():
            text = word.decode("utf-8", "replace")
            if word.islower() and word.isalpha():  # a-z, which are spelt as they are
                spelt = text
            elif PLAIN(text):
                spelt = text.translate(spelling)
            else:
                continue
            ids.extend([token.id for token in tokenize(spelt)])
            found.append(word)
            ends.append(len(ids))
        raw, size = np.array(ids, self.kind).tobytes(), self.kind.itemsize
        return {word: raw[begin * size : end * size] for word, begin, end in zip(found, ends, ends[1:])}

    def keep_repeated(self) -> None:
        """Forget the words met once only, and of the others all but the ``KEPT_WORDS`` most used.

        Most distinct words never come again. Uses count half from now on, so that words no longer
        met go in the end.
        """
        often = self.uses > 1
        if often.sum() > KEPT_WORDS:
            place = len(often) - KEPT_WORDS - 1
            often &= self.uses > np.partition(self.uses, place)[place]
        self.coded.keep(often)
        self.uses = self.uses[often] // 2
        self.table.keep(often)

    def encode(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Ids (little-endian, end id included), their number and the Hilbert key of each text.

        Every distinct word of the texts is looked up once; what it stands for is then put in its places.
        """
        if self.table.filled > CACHE_WORDS:
            self.keep_repeated()
        distinct, place, counts = words.distinct_words(texts)
        row = self.table.rows_of(distinct)
        uses = np.zeros(self.table.filled, np.int64)
        uses[: len(self.uses)] = self.uses
        uses[row] += np.bincount(place, minlength=len(distinct))
        self.uses = uses
        sums = np.zeros((len(counts), self.settings.dimensions + 1))
        if len(place):
            sums = words.sums_by_text(self.table.rows[row][place], counts)
        # The end id stands behind the words of each text like one word more.
        parts = np.insert(place, np.cumsum(counts), len(distinct))
        del distinct, place
        size = np.append(self.coded.size[row], np.int32(1))[parts]
        ids = self.coded.take(np.append(self.coded.start[row], 0)[parts], size)
        offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)[np.cumsum(counts + 1) - 1]])
        buffers = [None, pa.py_buffer((offsets * self.kind.itemsize).astype(np.int64)), pa.py_buffer(ids)]
        out = pa.Array.from_buffers(pa.large_binary(), len(counts), buffers)
        mean = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
        top = 1 << self.settings.bits
        # Means of many words lie close to zero; the square root spreads them.
        spread = np.sign(mean) * np.sqrt(np.abs(mean))
        cell = np.clip(((np.tanh(spread) + 1) / 2 * top).astype(np.int64), 0, top - 1)
        return out, np.diff(offsets), hilbert_keys(cell, self.settings.bits)

    def __call__(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
        """Ids and Hilbert key of each text."""
        ids, _, keys = self.encode(pa.array(texts, pa.string()))
        return ids.to_pylist(), keys


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer points with coordinates below 2**bits.

    From the highest bit down, each coordinate's bit decides whether the lower bits of the first
    coordinate are mirrored or swapped with its own; Gray code of the result is the place.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        side, below = 1 << level, (1 << level) - 1
        for axis in range(dims):
            far = (x[axis] & side) != 0
            swap = np.where(far, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(far, below, swap)
            x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = (key << 1) | ((x[axis] >> level) & 1)
    return key


def _tokens(docs: DataFrame, tokenizer: str, settings: Settings) -> DataFrame:
    """(doc_id, key, n, ids) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)  # the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, settings)
        for batch in batches:
            for part in words.slices(batch, "text", TEXT_CHARS):
                ids, n, keys = encoder.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(keys), pa.array(n), ids.cast(pa.binary())], names=["doc_id", "key", "n", "ids"]
                )

    return words.texts_of(docs).mapInArrow(words.releasing(run), "doc_id bigint, key bigint, n bigint, ids binary")


def _running_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens before each row within the partition, and the partition's number."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = np.asarray(batch.column("n"), np.int64)
        ends = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("n"), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n)],
            names=["row", "n", "part", "local"],
        )
        total = int(ends[-1]) if len(ends) else total


def pack(docs: DataFrame, settings: Settings) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    with open(settings.tokenizer, encoding="utf-8") as file:
        tokenizer = file.read()
    tokens = written(
        _tokens(docs, tokenizer, settings).withColumn("row", F.monotonically_increasing_id()), shared_dir(spark, "packing-tokens")
    )
    order = ("key", "doc_id", "row")
    placed = written(
        tokens.select("row", "doc_id", "key", "n")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_running_starts, "row bigint, n bigint, part int, local bigint"),
        shared_dir(spark, "packing-places"),
    )
    sums = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one per partition
    before, total = [], 0
    for part, n in sums:
        before.append((part, total))
        total += n
    bases = F.broadcast(spark.createDataFrame(before, "part int, base bigint"))
    starts = placed.join(bases, "part").select("row", (F.col("local") + F.col("base")).alias("place"))
    length = settings.length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            columns = (batch.column(name).to_pylist() for name in ("doc_id", "n", "ids", "place"))
            for doc_id, n, ids, place in zip(*columns):
                ids = np.frombuffer(ids, np.dtype(f"<u{len(ids) // n}")).astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(place + start, length)
                    size = min(length - offset, n - start)
                    row = (doc_id, start, size, zlib.crc32(ids[start : start + size].tobytes()), n, sequence, offset)
                    for column, value in zip(out.values(), row):
                        column.append(value)
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in out.values()], names=list(out))

    return (
        tokens.select("row", "doc_id", "n", "ids")
        .join(starts, "row")
        .select("doc_id", "n", "ids", "place")
        .mapInArrow(
            words.releasing(cut),
            "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
        )
    )
