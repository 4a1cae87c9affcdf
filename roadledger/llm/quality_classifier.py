"""Quality classifier: supervised subword embeddings.

Every word gives hashed features: itself, its character n-grams, and, when it repeats the word
before it, one shared mark. Each feature has a learned vector, a document is the mean of its
features' vectors, and a softmax layer reads the class from that mean. Vectors and layer are
trained together by numpy stochastic gradient descent on a bounded sample of labelled rows
(``Settings.rows_per_class`` of each class, those with the smallest hashes of their ids), whole
texts included. Sampling by class is undone in the bias, so scores keep the classes' true shares.

Scoring needs no vectors any more: the layer applied to a feature's vector is one number, so a
document's logit is a mean of table entries, computed for whole texts in one pass over the rows.

Defined results: null and empty texts score as the classes' shares say; with one class or none
among the training labels every score is that share (0.5 without labels). Null labels are left
out; a document labelled several times counts with its smallest label; rows with a null id are
never trained on. Repeated rows are scored one by one; extra columns are ignored by
:func:`scores` and carried by :func:`accepted`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadledger.llm import text as words

HELD_OUT_MODULUS = 5


@dataclass(frozen=True)
class Settings:
    rows_per_class: int = 1200
    buckets: int = 1 << 15
    ngrams: tuple[int, ...] = (3, 4)
    dimension: int = 12
    epochs: int = 12
    batch: int = 8
    rate: float = 0.15
    # A repeated word's mark counts like so many n-grams, else those of the words outweigh it.
    repeat_weight: int = 8
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """``logits``: per feature, class 1 against class 0; ``bias``: the same without any feature."""

    logits: np.ndarray
    bias: float
    prior: float
    settings: Settings
    trained: bool = True

    @property
    def repeat(self) -> int:
        return self.settings.buckets


def sample(labels: DataFrame, label: str, settings: Settings) -> DataFrame:
    """The training rows: (doc_id, label), at most ``rows_per_class`` of each class."""
    known = training_labels(labels, label)
    parts = [
        known.filter(F.col("label") == value)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(settings.rows_per_class)
        for value in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label 0 or 1) of all labelled rows that are not held out, one row per document."""
    return (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & (words.remainder("doc_id", HELD_OUT_MODULUS) != 0))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings = Settings()) -> Model:
    shares = {r["label"]: r["n"] for r in training_labels(labels, label).groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    if len(shares) < 2:
        prior = shares.get(1, 0) / total if total else 0.5
        return Model(np.zeros(settings.buckets + 1, np.float32), 0.0, prior, settings, trained=False)
    chosen = F.broadcast(sample(labels, label, settings))  # two classes of bounded size
    rows = words.texts_of(docs).join(chosen, "doc_id").select("label", "text")
    features = rows.mapInArrow(_feature_rows(settings), "label int, buckets array<int>, counts array<float>").toArrow()
    return train(
        np.asarray(features.column("label"), np.int64),
        [np.asarray(x, np.int64) for x in features.column("buckets").to_pylist()],
        [np.asarray(x, np.float32) for x in features.column("counts").to_pylist()],
        shares[1] / total,
        settings,
    )


def _feature_rows(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for part in words.slices(batch, "text"):
                buckets, counts = [], []
                for text in part.column("text").to_pylist():
                    found = words.words_of(text)
                    if len(cache) > words.CACHE_WORDS // 4:
                        cache.clear()
                    new = [word for word in dict.fromkeys(found) if word not in cache]
                    if new:
                        owner, found_in = words.subword_buckets(new, settings.ngrams, settings.buckets)
                        cache.update(zip(new, np.split(found_in, np.flatnonzero(np.diff(owner)) + 1)))
                    repeats = sum(a == b for a, b in zip(found, found[1:]))
                    flat = np.concatenate([*(cache[w] for w in found), np.full(repeats, settings.buckets)]) if found else np.empty(0, np.int64)
                    ids, n = np.unique(flat.astype(np.int64), return_counts=True)
                    buckets.append(ids.astype(np.int32))
                    n[ids == settings.buckets] *= settings.repeat_weight
                    counts.append(n.astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), pa.array(buckets, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))],
                    names=["label", "buckets", "counts"],
                )

    return run


def train(labels: np.ndarray, buckets: list, counts: list, prior: float, settings: Settings) -> Model:
    """Stochastic gradient descent with per-weight steps on mean embeddings and a softmax layer."""
    rng = np.random.default_rng(settings.seed)
    dim = settings.dimension
    vectors = rng.uniform(-1, 1, (settings.buckets + 1, dim)) / dim
    layer = np.zeros((dim, 2))
    bias = np.zeros(2)
    vector_steps, layer_steps = np.full(settings.buckets + 1, 1e-8), 1e-8
    full = [i for i in range(len(labels)) if len(buckets[i])]
    shares = [count / count.sum() for count in counts]
    weight = {c: len(full) / (2 * max(1, sum(labels[i] == c for i in full))) for c in (0, 1)}
    # Documents are visited in an order that depends on their features, not on how rows came in.
    full.sort(key=lambda i: (labels[i], len(buckets[i]), float(counts[i].sum()), int(buckets[i].sum())))
    for _ in range(settings.epochs):
        for start_order in np.array_split(rng.permutation(len(full)), max(1, len(full) // settings.batch)):
            layer_grad, bias_grad = np.zeros_like(layer), np.zeros(2)
            for k in start_order:
                i = full[k]
                ids, share = buckets[i], shares[i]
                mean = share @ vectors[ids]
                logits = mean @ layer + bias
                odds = np.exp(logits - logits.max())
                error = odds / odds.sum()
                error[labels[i]] -= 1
                error *= weight[labels[i]]
                layer_grad += np.outer(mean, error)
                bias_grad += error
                step = layer @ error
                size = share / share.max()
                vector_steps[ids] += (size**2) * (step @ step)
                vectors[ids] -= settings.rate * (size / np.sqrt(vector_steps[ids]))[:, None] * step
            layer_steps += (layer_grad**2).sum() + (bias_grad**2).sum()
            layer -= settings.rate * 4 * layer_grad / np.sqrt(layer_steps)
            bias -= settings.rate * 4 * bias_grad / np.sqrt(layer_steps)
    logits = (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32)
    odds = np.log(prior / (1 - prior))  # training weighs both classes alike
    return Model(logits, float(bias[1] - bias[0] + odds), prior, settings)


class Scorer:
    """Scores texts; per distinct word the sum of its features' logits and their number are kept."""

    def __init__(self, model: Model):
        self.model = model
        self.table = words.WordTable(self._features)

    def _features(self, new: list[bytes]) -> np.ndarray:
        owner, buckets = words.subword_buckets(new, self.model.settings.ngrams, self.model.settings.buckets)
        sums = np.bincount(owner, self.model.logits[buckets], len(new))
        return np.column_stack([sums, np.bincount(owner, minlength=len(new))])

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        flat, counts = self.table.lookup(texts)
        if not len(flat):
            return np.full(len(counts), self.model.prior)
        values = self.table.rows[flat]
        same = np.zeros(len(flat))
        same[1:] = flat[1:] == flat[:-1]
        firsts = (np.cumsum(counts) - counts)[counts > 0]
        same[firsts] = 0
        same *= self.model.settings.repeat_weight
        values[:, 0] += same * self.model.logits[self.model.repeat]
        values[:, 1] += same
        sums = words.sums_by_text(values, counts)
        logit = sums[:, 0] / np.maximum(sums[:, 1], 1) + self.model.bias
        score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return np.where((counts > 0) & self.model.trained, score, self.model.prior)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in words.slices(batch, "text"):
                found = scorer(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    return words.texts_of(docs).mapInArrow(run, "doc_id bigint, score double")


def accepted(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows that score ``threshold`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in words.slices(batch, "text"):
                yield part.filter(pa.array(scorer(part.column("text").to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
