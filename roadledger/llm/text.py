"""Words of texts as flat numpy arrays: groundwork of the operators that run inside Python tasks.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and
carriage return (``bytes.split`` cuts exactly there). Texts are handled whole and in slices of
bounded size, so a task holds a few megabytes of words at a time whatever the table size.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_CHARS = 2_000_000
# A word cache that reaches this size is started anew before the next slice.
CACHE_WORDS = 300_000
# So many new words are handled at once.
FRESH_WORDS = 1 << 16


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def release() -> None:
    """Give memory that is free by now back to the system.

    Spark's Python workers go on to other tasks, of other stages too, and the allocators keep what
    the largest of them has needed.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same task, with memory given back before it and after its caches are gone."""

    def released(batches: Iterator) -> Iterator:
        release()
        yield from run(batches)
        release()

    return released


def words_of(text: str | bytes | None) -> list[bytes]:
    if not text:
        return []
    return (text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).split()


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text, one row at least."""
    sizes = np.asarray(
        pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64
    )
    part = np.concatenate([[0], np.cumsum(sizes)])[:-1] // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for begin, end in zip(edges[:-1], edges[1:]):
        if end > begin:
            yield batch.slice(begin, end - begin)


def distinct_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of the texts in the order of first sight, the place of each word among them
    (text after text), and the number of words of each text."""
    cut = pa.compute.ascii_split_whitespace(pa.compute.fill_null(texts, ""))
    found = cut.values.dictionary_encode()
    place, ends = np.asarray(found.indices).astype(np.int64), np.asarray(cut.offsets).astype(np.int64)
    words = found.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    # White space at either end of a text leaves an empty piece there.
    nothing = words.index(b"") if b"" in words else None
    if nothing is not None:
        full = place != nothing
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
        place = place[full]
        place -= place > nothing
        del words[nothing]
    return words, place, np.diff(ends)


class WordIndex(dict):
    """word -> row number, given in the order of first sight; ``fresh`` are those not handled yet."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        row = self[word] = len(self)
        self.fresh.append(word)
        return row


class WordTable:
    """Caches rows of numbers per distinct word: ``features(words)`` gives them for new words."""

    def __init__(self, features: Callable[[list[bytes]], np.ndarray], limit: int = CACHE_WORDS):
        self.features, self.limit = features, limit
        self._reset()

    def _reset(self) -> None:
        self.index, self.rows, self.filled = WordIndex(), None, 0

    def lookup(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of all words of the texts, and the number of words of each text.

        The numbers hold for :attr:`rows` until the next call.
        """
        if len(self.index) > self.limit:
            self._reset()
        get, parts, counts = self.index.__getitem__, [], []
        for text in texts:
            words = words_of(text)
            counts.append(len(words))
            parts.append(np.fromiter(map(get, words), np.int64, len(words)))
        if self.index.fresh:
            self._append(self.features(self.index.fresh))
            self.index.fresh.clear()
        flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
        return flat, np.asarray(counts, np.int64)

    def _append(self, new: np.ndarray) -> None:
        if self.rows is None:
            self.rows = np.empty((max(1024, 2 * len(new)), *new.shape[1:]), new.dtype)
        while self.filled + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[self.filled : self.filled + len(new)] = new
        self.filled += len(new)


class DigestTable(WordTable):
    """Caches rows of numbers per distinct word like :class:`WordTable`, but keeps 128-bit digests of the
    words instead of the words: a fifth of the memory. ``index`` are the first halves in ascending order."""

    def _reset(self) -> None:
        self.index, self.second, self.place = (np.empty(0, kind) for kind in (np.uint64, np.uint64, np.int32))
        self.rows, self.filled = None, 0

    def keep(self, mask: np.ndarray) -> None:
        """Only the rows marked stay, in their order."""
        kept = mask[self.place]
        self.index, self.second = self.index[kept], self.second[kept]
        self.place = (np.cumsum(mask) - 1).astype(np.int32)[self.place[kept]]
        self.rows = self.rows[: self.filled][mask]
        self.filled = len(self.rows)

    def rows_of(self, words: list[bytes]) -> np.ndarray:
        """Row numbers of different words."""
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
        # Ascending digests are found faster.
        order = np.argsort(digests[:, 0])
        one, two = digests[order].T
        out = np.full(len(words), -1, np.int64)
        if len(self.index):
            at = np.minimum(np.searchsorted(self.index, one), len(self.index) - 1)
            known = (self.index[at] == one) & (self.second[at] == two)
            out[order[known]] = self.place[at[known]]
        fresh = np.flatnonzero(out < 0)
        if len(fresh):
            out[fresh] = np.arange(self.filled, self.filled + len(fresh))
            for begin in range(0, len(fresh), FRESH_WORDS):
                self._append(self.features([words[k] for k in fresh[begin : begin + FRESH_WORDS].tolist()]))
            self.index = np.concatenate([self.index, digests[fresh, 0]])
            merged = np.argsort(self.index, kind="stable")
            self.index = self.index[merged]
            self.second = np.concatenate([self.second, digests[fresh, 1]])[merged]
            self.place = np.concatenate([self.place, out[fresh].astype(np.int32)])[merged]
        return out


def sums_by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches; zero for empty ones."""
    out = np.zeros((len(counts), *values.shape[1:]), np.float64)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(values, starts, axis=0, dtype=np.float64)
    return out


def hash64(words: Iterable[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(word) for word in words], np.uint64)


def mix64(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that every bit depends on every bit."""
    x = values.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def pair64(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    with np.errstate(over="ignore"):
        return mix64(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ np.uint64(0xD6E8FEB86659FD93)))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` word hashes; of the whole sequence if it is shorter.

    Runs of doubled lengths are put together, so the work grows with the logarithm of the size.
    """
    if len(words) == 0:
        return words
    size = min(size, len(words))
    out, covered, power, length = None, 0, mix64(words), 1
    while True:
        if size & length:
            count = len(words) - covered - length + 1
            out = power[:count] if out is None else pair64(out[:count], power[covered : covered + count])
            covered += length
        length *= 2
        if length > size:
            return out
        power = pair64(power[: -length // 2 or None], power[length // 2 :])


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


DIGITS = bytes.maketrans(b"123456789", b"000000000")


def subword_buckets(words: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words: the word itself and its character n-grams, word bounds marked.

    Returns (number of the word, bucket) for every feature, ordered by word. All digits count as
    the same one.
    """
    marked = [f"<{word.translate(DIGITS).decode('utf-8', 'replace')}>" for word in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(word) for word in marked], np.int64)
    owner = np.repeat(np.arange(len(marked)), lengths)
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))
    owners, found = [np.arange(len(marked))], [hash64(word.encode("utf-8", "surrogatepass") for word in marked)]
    gram = mix64(points)
    for size in range(2, max(sizes, default=0) + 1):
        gram = pair64(gram[:-1], points[size - 1 :])
        if size in sizes:
            fits = room[: len(gram)] >= size
            owners.append(owner[: len(gram)][fits])
            found.append(gram[fits])
    if 1 in sizes:
        owners.append(owner)
        found.append(mix64(points))
    owner, found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return owner[order], (found[order] % np.uint64(buckets)).astype(np.int64)


def texts_of(docs: DataFrame) -> DataFrame:
    """Only id and text, whatever else the table carries (or however its columns are named)."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
