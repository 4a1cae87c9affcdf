"""Toxicity: class-conditional Kneser-Ney models of word pairs.

For each class (toxic, ordinary) a word's probability after the word before it (or the start of the
text) is the count of that pair less an absolute discount, divided by the count of the word before;
what the discount frees goes to the word's continuation probability, so an expression backs off to its
words: p(w | v) = max(n(v, w) - d, 0) / n(v) + d * kinds(v) / n(v) * p(w), with p(w) alone where the
class has not seen v. The continuation probability is the number of different words the word follows
in that class, less a discount; what that frees goes to a distribution both classes share, again by
continuation: there a word counts once for every class it occurs in, so expressions one class alone is
fond of are rare in it. Discounts are estimated from the counts of counts of their level. Pairs are
counted as often as they occur, continuations do not grow with copies of a text or repeats in it. A
word that neither class has seen says nothing: both back off to the same value.

The counts cover all training rows but the bounded sample set aside for calibration; they are taken by
Spark, whole texts, and grow with the corpus. No word or pair is left out of them, however rare, and no
ratio is rounded to nothing. The tables stay in Spark, in buckets of the hashes of their words and pairs:
texts are cut into slices, the distinct words and pairs of a slice go to their buckets, and what is found
there goes back to the slice, whose tokens are kept as places in the list of its words. So a common word or
pair is looked up once per slice, and only scalars go to executors. What a slice asks of a bucket is one row
of packed numbers, and so is the answer; documents are scored in a fixed number of waves, by the hash of
their id, and what a wave shuffles is dropped at its end. A task holds a slice, or one bucket of the tables.

A document's evidence are log-likelihood ratios, normalised by length: per word over the text, per
word of its most toxic stretch of ``window`` words, of its most toxic expression, and the excess
over ``strong`` per document, each of the pairs and again (``word_``) of the level they back off to.
A logistic curve over these, which weighs the levels against each other, fitted on the rows set aside (of
each class those with the smallest hashes of one remainder, ``calibration_rows`` at most, so that small
tables keep most rows to learn from), gives the score.

Defined results: null and empty texts score as if no word said anything; without rows of both classes
every score is the toxic share (0.5 without labels). Null labels and ids are left out; a document
labelled several times counts with its largest label; repeated rows are scored one by one; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadledger.llm import text as words
from roadledger.session import shared_dir, shuffles_dropped, written

HELD_OUT_MODULUS = 5
CALIBRATION = 4
CLASSES = ("toxic", "ordinary")
# Label tables of so many rows are sent to all executors; larger ones are joined by shuffle.
BROADCAST_LABELS = 2_000_000
EDGES = b".,;:!?\"'`()[]{}<>|*#$%&+-_/\\=~^@"


@dataclass(frozen=True)
class Settings:
    # Floors of ``log_ratios``, a view of the table; scores use all words.
    least_share: float = 0.0
    least_ratio: float = 0.0
    strong: float = 2.5
    window: int = 8
    calibration_rows: int = 2000


@dataclass(frozen=True)
class Model:
    """``table``: a row of ``WORDS`` for every word, ``pairs``: (before, word, toxic, ordinary), how often each
    pair occurs (None: nothing learned), ``discounts`` of pairs, toxic and ordinary; ``packed``: both tables by bucket,
    made by :func:`evidence` if it is not there."""

    table: DataFrame | None
    pairs: DataFrame | None
    discounts: tuple[float, float]
    prior: float
    settings: Settings
    weights: np.ndarray | None = None
    packed: Packed | None = None


def word_keys(found: list[bytes]) -> np.ndarray:
    """Hashes of words in lower case, without punctuation around them."""
    # One text with a word in each line: a line feed is in no word, and what stands beyond it does not change lower case.
    lines = b"\n".join(found).decode("utf-8", "replace").lower().encode("utf-8").split(b"\n") if found else []
    return words.hash64(w.strip(EDGES) for w in lines)


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label, part): labelled rows that are not held out, one per document."""
    part = words.remainder("doc_id", HELD_OUT_MODULUS)
    return (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & (part != 0))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .withColumn("part", part)
    )


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different words of the texts, ascending, with the 0 that starts a text; places among them
    of all words and of the words before them; words per text."""
    found, place, counts = words.distinct_words(texts)
    keys, same = np.unique(np.concatenate([np.zeros(1, np.uint64), word_keys(found)]), return_inverse=True)
    second = same[1:][place]
    return keys, second, _before(second, counts, same[0]), counts


def _before(second: np.ndarray, counts: np.ndarray, start: int) -> np.ndarray:
    first = np.concatenate([[start], second])[:-1]
    first[(np.cumsum(counts) - counts)[counts > 0]] = start
    return first


_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _hash_long(values: np.ndarray, seed: np.ndarray) -> np.ndarray:
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = (seed + _P5 + np.uint64(8)) ^ (turned(values * _P2, 31) * _P1)
        h = turned(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """What ``F.xxhash64("before", "word")`` gives in Spark, so that counts need not carry it."""
    return _hash_long(word, _hash_long(before, np.full(1, 42, np.uint64)))


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of neighbouring words with the number of times they occur in each class."""
    for batch in batches:
        for part in words.slices(batch, "text", LOOKUP_CHARS):
            keys, second, first, counts = _cut(part.column("text"))
            if not len(second):
                continue
            label = np.repeat(np.asarray(part.column("label"), np.int64), counts)
            pairs, number = np.unique(first * len(keys) + second, return_inverse=True)
            toxic = np.bincount(number[label == 1], minlength=len(pairs))
            ordinary = np.bincount(number[label != 1], minlength=len(pairs))
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(keys[k].view(np.int64)) for k in np.divmod(pairs, len(keys))),
                    *(pa.array(n.astype(np.int64)) for n in (toxic, ordinary)),
                ],
                names=["before", "word", *CLASSES],
            )


def pair_counts(rows: DataFrame) -> DataFrame:
    """(before, word, toxic, ordinary): how often each word follows each other one in each class."""
    return (
        rows.mapInArrow(words.releasing(_pair_rows), "before bigint, word bigint, toxic bigint, ordinary bigint")
        .groupBy("before", "word")
        .agg(*(F.sum(name).alias(name) for name in CLASSES))
    )


def _kinds(pairs: DataFrame, key: str) -> DataFrame:
    """(key, toxic, ordinary): in how many different pairs of each class the key occurs."""
    return pairs.groupBy(key).agg(*(F.count_if(F.col(name) > 0).alias(name) for name in CLASSES))


def continuation_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, ordinary): how many different words each word follows in each class."""
    return _kinds(pair_counts(rows), "word")


def histories(pairs: DataFrame) -> DataFrame:
    """(before, toxic_all, ordinary_all, toxic_kinds, ordinary_kinds): pairs a word begins, all and different ones."""
    return pairs.groupBy("before").agg(
        *(F.sum(name).alias(f"{name}_all") for name in CLASSES),
        *(F.count_if(F.col(name) > 0).alias(f"{name}_kinds") for name in CLASSES),
    )


def pair_discounts(pairs: DataFrame) -> tuple[float, float]:
    found = pairs.agg(*(F.count_if(F.col(name) == n).alias(f"{name}_{n}") for name in CLASSES for n in (1, 2))).first()
    return tuple(_discount(found[f"{name}_1"], found[f"{name}_2"]) for name in CLASSES)


# Of a word: its continuation probabilities, and the pairs it begins.
HISTORY = ("toxic_all", "ordinary_all", "toxic_kinds", "ordinary_kinds")
WORDS = (*CLASSES, *HISTORY)


def word_table(pairs: DataFrame) -> DataFrame:
    """(word, WORDS): probability 0 for what is never a second word (the start), no history for a last word."""
    path = shared_dir(pairs.sparkSession, "toxicity-words")
    counts = written(_kinds(pairs, "word"), f"{path}/counts")
    single = probabilities(counts).select("word", *(F.col(f"{name}_p").alias(name) for name in CLASSES))
    joined = single.join(histories(pairs).withColumnRenamed("before", "word"), "word", "full")
    return written(joined.select("word", *(F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias(name) for name in WORDS)), f"{path}/table")


def log_ratio(toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Log ratio of probabilities; 0 for words of neither class, where both are 0."""
    known = (toxic > 0) & (ordinary > 0)
    return np.where(known, np.log(np.where(known, toxic, 1) / np.where(known, ordinary, 1)), 0.0)


def pair_ratios(counts: np.ndarray, second: np.ndarray, first: np.ndarray, discounts: tuple[float, float]) -> np.ndarray:
    """Log ratios p(w | v) toxic to ordinary: counts of the pairs, rows of WORDS of their second and first words."""
    chance = []
    for i, discount in enumerate(discounts):
        everything, kinds = first[:, 2 + i], first[:, 4 + i]
        whole = np.maximum(everything, 1)
        freed = np.where(everything > 0, discount * kinds / whole, 1.0)
        chance.append(np.maximum(counts[:, i] - discount, 0) / whole + freed * second[:, i])
    return log_ratio(*chance)


def _discount(ones: int, twos: int) -> float:
    """The usual estimate, kept away from 0 and 1 for tiny tables."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def probabilities(counts: DataFrame) -> DataFrame:
    """``counts`` with toxic_p and ordinary_p, the probabilities of each word in the classes."""
    sums = counts.agg(
        *(F.sum(name).alias(f"{name}_sum") for name in CLASSES),
        *(F.count_if(F.col(name) > 0).alias(f"{name}_types") for name in CLASSES),
        *(F.count_if(F.col(name) == n).alias(f"{name}_{n}") for name in CLASSES for n in (1, 2)),
    ).first()
    types = sums["toxic_types"] + sums["ordinary_types"]
    shared = ((F.col("toxic") > 0).cast("int") + (F.col("ordinary") > 0).cast("int")) / F.lit(float(types))

    def probability(name: str):
        total, discount = float(sums[f"{name}_sum"]), _discount(sums[f"{name}_1"], sums[f"{name}_2"])
        freed = discount * sums[f"{name}_types"] / total
        return F.greatest(F.col(name) - F.lit(discount), F.lit(0.0)) / F.lit(total) + F.lit(freed) * shared

    found = counts.withColumns({f"{name}_p": probability(name) for name in CLASSES})
    return found.withColumns({f"{name}_share": F.col(name) / F.lit(float(sums[f"{name}_sum"])) for name in CLASSES})


def log_ratios(counts: DataFrame, settings: Settings) -> DataFrame:
    """(word, ratio) of the words, those below the floors left out."""
    found = probabilities(counts).withColumn("ratio", F.log(F.col("toxic_p") / F.col("ordinary_p")))
    share = F.greatest("toxic_share", "ordinary_share")
    return found.filter((share >= settings.least_share) & (F.abs("ratio") >= settings.least_ratio)).select("word", "ratio")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings = Settings()) -> Model:
    spark = docs.sparkSession
    known = written(training_labels(labels, label), shared_dir(spark, "toxicity-labels"))
    shares = known.agg(F.count("*").alias("total"), F.count_if(F.col("label") == 1).alias("toxic")).first()
    total, toxic = shares["total"], shares["toxic"]
    prior = toxic / total if total else 0.5
    nothing = Model(None, None, (0.5, 0.5), prior, settings)
    if not 0 < toxic < total:
        return nothing
    chosen = [
        known.filter((F.col("part") == CALIBRATION) & (F.col("label") == value))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(settings.calibration_rows)
        for value in (0, 1)
    ]
    aside = written(chosen[0].unionByName(chosen[1]).select("doc_id", "label"), shared_dir(spark, "toxicity-aside"))
    aside = F.broadcast(aside)  # bounded
    learned = known.join(aside, "doc_id", "left_anti").select("doc_id", "label")
    if total <= BROADCAST_LABELS:
        learned = F.broadcast(learned)
    texts = words.texts_of(docs)
    with shuffles_dropped(spark):
        pairs = written(pair_counts(texts.join(learned, "doc_id").select("label", "text")), shared_dir(spark, "toxicity-pairs"))
        if any(pairs.filter(F.col(name) > 0).isEmpty() for name in CLASSES):
            return nothing
        table = word_table(pairs)
        model = Model(table, pairs, pair_discounts(pairs), prior, settings, packed=packed(table, pairs))
    rows = evidence(texts.join(aside, "doc_id"), model, waves=1).select("label", *EVIDENCE).toArrow()
    return replace(model, weights=calibrated(rows, prior))


MEASURES = ("mean", "stretch", "expression", "excess")
EVIDENCE = (*MEASURES, *(f"word_{name}" for name in MEASURES))
JUDGED = "doc_id bigint, label int, " + ", ".join(f"{name} double" for name in (*EVIDENCE, "score"))
# Words of so many bytes of text are looked up at once; less text, more lookups of the same word.
LOOKUP_CHARS = 2 * words.SLICE_CHARS
# Documents are scored in so many waves, in fewer if they are few.
WAVES = 10
WAVE_ROWS = 4000
# A bucket of the tables has about so many pairs at most; a task holds one at a time. There are two buckets a
# shuffle partition, to share the work, but not beyond ``BUCKETS``: every slice asks nearly all of them.
BUCKET_PAIRS = 500_000
BUCKETS = 512
# So many rows of the tables are sorted and dealt to buckets at once.
MODEL_ROWS = 500_000
# Tasks hand on rows of so many bytes together.
ROWS_BYTES = 4_000_000
# ``slice`` of rows of the tables, which come before what is asked of them.
MODEL = -1
# Rows of the tables (hashes and values), of what slices ask (hashes) and of the answers (values), by bucket;
# what a slice keeps for itself (``body``) comes after all answers.
PACKED = "bucket int, slice bigint, words binary, pairs binary, body binary"
BODY = ("docs", "labels", "lengths", "keys", "tokens")


def _pack(values: np.ndarray) -> bytes:
    """Numbers, column by column, their bytes of equal weight together, compressed."""
    flat = np.ascontiguousarray(values.T).reshape(-1)
    planes = np.ascontiguousarray(flat.view(np.uint8).reshape(len(flat), flat.itemsize).T)
    return len(values).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, kind: type, columns: int = 1) -> np.ndarray:
    n, size = int.from_bytes(packed[:4], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(packed[4:], n * columns * size, codec="zstd", asbytes=True)
    flat = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n * columns).T).view(kind)
    return flat.reshape(n) if columns == 1 else flat.reshape(columns, n).T


def _pack_keys(keys: np.ndarray) -> bytes:
    """Differences of hashes: small where they ascend."""
    return _pack(np.diff(keys, prepend=np.zeros(1, np.uint64)))


def _unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed, np.uint64), dtype=np.uint64)


def _edges(keys: np.ndarray, bits: int) -> list[int]:
    """Where the buckets begin and end among ascending hashes: a bucket is their first ``bits`` bits."""
    inner = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, np.uint64)
    return [0, *np.searchsorted(keys, inner).tolist(), len(keys)]


def _rows(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of the rows of ``PACKED``, a few megabytes each."""
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=[c.split()[0] for c in PACKED.split(", ")])

    for row in rows:
        held.append(row)
        size += sum(len(value) for value in row[2:] if value)
        if size > ROWS_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _pack_table(keys: np.ndarray, values: np.ndarray) -> bytes:
    first = _pack_keys(keys)
    return len(first).to_bytes(4, "little") + first + _pack(values)


def _merged(parts: list[bytes], kind: type, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and values of what :func:`_pack_table` has packed."""
    keys, values = [np.empty(0, np.uint64)], [np.empty((0, columns), kind)]
    for part in parts:
        end = 4 + int.from_bytes(part[:4], "little")
        keys.append(_unpack_keys(part[4:end]))
        values.append(_unpack(part[end:], kind, columns))
    if len(parts) == 1:
        return keys[1], values[1]
    key = np.concatenate(keys)
    order = np.argsort(key)
    return key[order], np.concatenate(values)[order]


@dataclass(frozen=True)
class Packed:
    """The tables of a model, a row of ``PACKED`` for each bucket of which ``words`` and ``pairs`` are hashes and values."""

    rows: DataFrame
    bits: int


def _dealt(bits: int, kind: str, columns: list[str], number: type):
    """Rows (key, columns) of one of the tables, packed by bucket."""

    def packed(key: np.ndarray, values: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(key)
        key, values = key[order], values[order]
        edges = _edges(key, bits)
        for bucket, (begin, end) in enumerate(zip(edges[:-1], edges[1:])):
            if end > begin:
                part = _pack_table(key[begin:end], values[begin:end])
                yield (bucket, MODEL, part, None, None) if kind == "words" else (bucket, MODEL, None, part, None)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, size = [], 0
        for batch in batches:
            key = np.asarray(batch.column("key")).view(np.uint64)
            held.append((key, np.column_stack([np.asarray(batch.column(c), number) for c in columns])))
            size += len(key)
            if size >= MODEL_ROWS:
                yield from packed(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if held:
            yield from packed(*map(np.concatenate, zip(*held)))

    return words.releasing(lambda batches: _rows(rows(batches)))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket from its parts, which follow each other."""

    def row(bucket: int, parts: tuple[list[bytes], list[bytes]]) -> tuple:
        kinds = (np.float64, len(WORDS)), (np.int64, len(CLASSES))
        return bucket, MODEL, *(_pack_table(*_merged(held, *kind)) if held else None for held, kind in zip(parts, kinds)), None

    def rows() -> Iterator[tuple]:
        here, parts = None, ([], [])
        for batch in batches:
            for bucket, *both in zip(*(batch.column(c).to_pylist() for c in ("bucket", "words", "pairs"))):
                if bucket != here:
                    if here is not None:
                        yield row(here, parts)
                    here, parts = bucket, ([], [])
                for held, part in zip(parts, both):
                    if part is not None:
                        held.append(part)
        if here is not None:
            yield row(here, parts)

    return _rows(rows())


def packed(table: DataFrame, pairs: DataFrame) -> Packed:
    """The tables in buckets, written."""
    spark = pairs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = (max(min(2 * tasks, BUCKETS), -(-pairs.count() // BUCKET_PAIRS)) - 1).bit_length()
    single = table.select(F.col("word").alias("key"), *WORDS).mapInArrow(_dealt(bits, "words", list(WORDS), np.float64), PACKED)
    double = pairs.select(F.xxhash64("before", "word").alias("key"), *CLASSES).mapInArrow(_dealt(bits, "pairs", list(CLASSES), np.int64), PACKED)
    parts = single.unionByName(double).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return Packed(written(parts.mapInArrow(words.releasing(_gathered), PACKED), shared_dir(spark, "toxicity-packed")), bits)


def _sliced(bits: int):
    """Slices of texts: what they ask of each bucket, and what they keep for themselves."""
    single = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
    blob = lambda value: pa.array([value], pa.binary())

    def asked(part: pa.RecordBatch, number: int) -> Iterator[tuple]:
        keys, second, first, counts = _cut(part.column("text"))
        pairs = np.sort(pair_keys(keys[first], keys[second]))
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
        ends = _edges(keys, bits), _edges(pairs, bits)
        for bucket, (a, b, c, d) in enumerate(zip(ends[0][:-1], ends[0][1:], ends[1][:-1], ends[1][1:])):
            if b > a or d > c:
                yield bucket, number, _pack_keys(keys[a:b]) if b > a else None, _pack_keys(pairs[c:d]) if d > c else None, None
        # Frequent words have small places; words of equal frequency keep their order.
        order = np.argsort(-np.bincount(second, minlength=len(keys)), kind="stable")
        place = np.empty(len(keys), np.int32)
        place[order] = np.arange(len(keys), dtype=np.int32)
        body = pa.RecordBatch.from_arrays(
            [
                single(part.column("doc_id"), pa.int64()),
                single(part.column("label"), pa.int32()),
                single(counts, pa.int64()),
                blob(_pack_keys(keys[order])),
                blob(_pack(place[second])),
            ],
            names=list(BODY),
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(body)
        # Any bucket will do, but not the same one for the first slices of all tasks.
        yield (number + (number >> 32)) % (1 << bits), number, None, None, sink.getvalue().to_pybytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in words.slices(batch, "text", LOOKUP_CHARS):
                yield from asked(part, number)
                number += 1

    return words.releasing(lambda batches: _rows(rows(batches)))


def _looked_up(bits: int):
    """Answers of the buckets to what slices ask of them: values of each hash, 0 where the table has none."""

    def answer(asked: bytes | None, key: np.ndarray, values: np.ndarray) -> bytes | None:
        if asked is None:
            return None
        wanted = _unpack_keys(asked)
        out = np.zeros((len(wanted), values.shape[1]), values.dtype)
        if len(key):
            at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            known = key[at] == wanted
            out[known] = values[at[known]]
        return _pack(out)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        here, parts, tables = None, ([], []), None
        for batch in batches:
            columns = [batch.column(c) for c in ("bucket", "slice", "words", "pairs", "body")]
            for bucket, number, single, double, body in zip(*columns):
                bucket, number, single, double, body = (v.as_py() for v in (bucket, number, single, double, body))
                if body is not None:
                    yield 1 << bits, number, None, None, body
                    continue
                if bucket != here:
                    here, parts, tables = bucket, ([], []), None
                if number == MODEL:
                    for held, part in zip(parts, (single, double)):
                        if part is not None:
                            held.append(part)
                    continue
                if tables is None:
                    tables = _merged(parts[0], np.float64, len(WORDS)), _merged(parts[1], np.int64, len(CLASSES))
                    parts = [], []
                yield bucket, number, answer(single, *tables[0]), answer(double, *tables[1]), None

    return lambda batches: _rows(rows(batches))


def measures(ratio: np.ndarray, counts: np.ndarray, settings: Settings) -> np.ndarray:
    """Length-normalised evidence of texts from the ratios of all their words, one text after the other."""
    out = np.zeros((len(counts), len(MEASURES)))
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = (np.cumsum(counts) - counts)[full]
    count = counts[full]
    out[full, 0] = np.add.reduceat(ratio, starts) / count
    # Stretches from every word on that has enough words after it; a shorter text is one stretch.
    span = np.repeat(np.minimum(settings.window, count), count)
    place = np.arange(len(ratio))
    fits = place - np.repeat(starts, count) + span <= np.repeat(count, count)
    sums = np.concatenate([[0.0], np.cumsum(ratio)])
    stretch = (sums[np.minimum(place + span, len(ratio))] - sums[:-1]) / span
    out[full, 1] = np.maximum.reduceat(np.where(fits, stretch, -np.inf), starts)
    out[full, 2] = np.maximum.reduceat(ratio, starts)
    out[full, 3] = np.log1p(np.add.reduceat(np.maximum(ratio - settings.strong, 0), starts))
    return out


def logistic(found: np.ndarray, weights: np.ndarray | None, prior: float) -> np.ndarray:
    if weights is None:
        return np.full(len(found), prior)
    return 1 / (1 + np.exp(-np.clip(found @ weights[:-1] + weights[-1], -30, 30)))


def calibrated(rows: pa.Table, prior: float) -> np.ndarray | None:
    """Weights of a logistic curve over the evidence, by Newton steps with a little shrinkage."""
    label = np.asarray(rows.column("label"), np.float64)
    x = np.column_stack([*(np.asarray(rows.column(name), np.float64) for name in EVIDENCE), np.ones(len(label))])
    if not 0 < label.sum() < len(label):
        # Nothing was set aside of one class: the expression's ratio against the classes' odds.
        return np.array([*(float(name == "expression") for name in EVIDENCE), np.log(prior / (1 - prior))])
    order = np.lexsort((*x.T, label))
    x, label = x[order], label[order]
    share = label.mean()
    weight = np.where(label == 1, prior / share, (1 - prior) / (1 - share))
    beta, shrink = np.zeros(x.shape[1]), np.array([0.05] * len(EVIDENCE) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (label - p)) - shrink * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(curve, gradient)
        beta += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _answered(weights: np.ndarray | None, prior: float, discounts: tuple[float, float], settings: Settings):
    def judge(body: pa.Buffer, answers: tuple[list[bytes], list[bytes]]) -> pa.RecordBatch:
        row = pa.ipc.open_stream(body).read_next_batch()
        docs, labels, lengths = (row.column(name).flatten() for name in BODY[:3])
        keys, second = _unpack_keys(row.column("keys")[0].as_py()), _unpack(row.column("tokens")[0].as_py(), np.int32)
        lengths = np.asarray(lengths, np.int64)
        first = _before(second, lengths, int(np.flatnonzero(keys == 0)[0]))
        single = np.empty((len(keys), len(WORDS)))
        single[np.argsort(keys)] = np.concatenate([_unpack(part, np.float64, len(WORDS)) for part in answers[0]])
        pairs, tokens = np.unique(pair_keys(keys[first], keys[second]), return_inverse=True)
        counts = np.concatenate([np.empty((0, len(CLASSES))), *(_unpack(part, np.int64, len(CLASSES)) for part in answers[1])])
        token = np.empty(len(pairs), np.int64)
        token[tokens] = np.arange(len(tokens))
        second, first = second[token], first[token]
        levels = pair_ratios(counts, single[second], single[first], discounts), log_ratio(*single[second, :2].T)
        found = np.hstack([measures(ratio[tokens], lengths, settings) for ratio in levels])
        score = logistic(found, weights, prior)
        return pa.RecordBatch.from_arrays([docs, labels, *(pa.array(c) for c in found.T), pa.array(score)], names=["doc_id", "label", *EVIDENCE, "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: tuple[list[bytes], list[bytes]] = [], []
        for batch in batches:
            for single, double, body in zip(*(batch.column(c) for c in ("words", "pairs", "body"))):
                for held, part in zip(answers, (single, double)):
                    if part.is_valid:
                        held.append(part.as_py())
                if body.is_valid:
                    yield judge(body.as_buffer(), answers)
                    answers = [], []

    return run


def evidence(docs: DataFrame, model: Model, waves: int | None = None) -> DataFrame:
    """(doc_id, label, evidence, score) of every row of (doc_id, text, label), written."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("label").cast("int").alias("label"))
    if model.table is None:
        return docs.select("doc_id", "label", *(F.lit(0.0).alias(name) for name in EVIDENCE), F.lit(float(model.prior)).alias("score"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    judge = _answered(model.weights, model.prior, model.discounts, model.settings)
    path = shared_dir(spark, "toxicity-evidence")
    with shuffles_dropped(spark):
        waves = waves or max(1, min(WAVES, -(-docs.count() // WAVE_ROWS)))
        tables = model.packed or packed(model.table, model.pairs)
        for wave in range(waves):
            part = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(waves)) == wave)
            rows = part.mapInArrow(_sliced(tables.bits), PACKED).unionByName(tables.rows)
            rows = rows.repartition(tasks, "bucket").sortWithinPartitions("bucket", "slice")
            rows = rows.mapInArrow(_looked_up(tables.bits), PACKED)
            rows = rows.repartition(tasks, "slice").sortWithinPartitions("slice", "bucket")
            rows.mapInArrow(judge, JUDGED).write.parquet(f"{path}/{wave}")
    return spark.read.schema(JUDGED).parquet(*(f"{path}/{wave}" for wave in range(waves)))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, evidence columns, score) of every row."""
    return evidence(words.texts_of(docs).withColumn("label", F.lit(None).cast("int")), model).drop("label")
