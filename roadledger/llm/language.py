"""Language identification in two steps: the family, then the language within it.

Features are hashed words and character 1- to 3-grams, as shares of a text's features. One linear
support vector machine per family, against all others, picks the family; within it one machine for
every pair of languages votes. All are trained by numpy stochastic gradient descent on hinge loss
over a bounded sample (``Settings.rows_per_language`` rows of each language, those with the
smallest hashes of their ids), whole texts included. Scoring multiplies nothing: a machine's margin
is a mean of per-word sums, so each distinct word is weighed once and texts are summed up whole.

``FAMILIES`` are names of related languages; a language it does not list is a family of its own.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every text
when no row can be learned from. Rows with a null language or text are not learned from, nor are
rows without an id. Ties go to the language first in alphabetical order. Repeated rows are scored one
by one; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadledger.llm import text as words

HELD_OUT_MODULUS = 3
HELD_OUT = 1
UNDETERMINED = "und"
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
    "uralic": "et fi hu",
    "sinitic": "yue zh",
}
_FAMILY = {language: family for family, names in FAMILIES.items() for language in names.split()}
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Settings:
    rows_per_language: int = 500
    buckets: int = 1 << 14
    ngrams: tuple[int, ...] = (1, 2, 3)
    epochs: int = 10
    rate: float = 0.5
    shrink: float = 1e-5
    seed: int = 11


def family_of(language: str) -> str:
    return _FAMILY.get(language.lower().split("-")[0].split("_")[0], f"only {language}")


@dataclass(frozen=True)
class Model:
    """Columns of ``weights``: one per family, then one per pair of languages of a family."""

    languages: list[str]
    families: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray
    settings: Settings


def sample(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, lang): the rows to learn from, at most ``rows_per_language`` of each language."""
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (words.remainder("doc_id", HELD_OUT_MODULUS) != HELD_OUT)
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    return known.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= settings.rows_per_language).select("doc_id", "lang")


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    chosen = F.broadcast(sample(docs, settings).dropDuplicates(["doc_id"]))  # bounded per language
    rows = words.texts_of(docs).join(chosen, "doc_id").select("lang", "text")
    found = rows.mapInArrow(_feature_rows(settings), "lang string, buckets array<int>, shares array<float>").toArrow()
    return train(
        found.column("lang").to_pylist(),
        [np.asarray(x, np.int64) for x in found.column("buckets").to_pylist()],
        [np.asarray(x, np.float32) for x in found.column("shares").to_pylist()],
        settings,
    )


def _feature_rows(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                buckets, shares = [], []
                for text in part.column("text").to_pylist():
                    distinct, times = np.unique(np.array(words.words_of(text), object), return_counts=True)
                    if not len(distinct):
                        buckets.append([])
                        shares.append([])
                        continue
                    owner, found = words.subword_buckets(distinct.tolist(), settings.ngrams, settings.buckets)
                    total = np.bincount(found, times[owner], settings.buckets)
                    ids = np.flatnonzero(total)
                    buckets.append(ids.astype(np.int32))
                    shares.append((total[ids] / total.sum()).astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
                    names=["lang", "buckets", "shares"],
                )

    return run


def train(langs: list[str], buckets: list, shares: list, settings: Settings) -> Model:
    full = [i for i in range(len(langs)) if len(buckets[i])]
    full.sort(key=lambda i: (langs[i], len(buckets[i]), int(buckets[i].sum()), float(shares[i].max())))
    languages = sorted({langs[i] for i in full})
    families = sorted({family_of(language) for language in languages})
    pairs = [p for p in itertools.combinations(range(len(languages)), 2) if family_of(languages[p[0]]) == family_of(languages[p[1]])]
    number = {language: k for k, language in enumerate(languages)}
    own = np.array([number[langs[i]] for i in full], np.int64)
    family = np.array([families.index(family_of(language)) for language in languages], np.int64)
    # +1 / -1 where a machine separates a row, 0 where the row is none of its languages.
    targets = np.zeros((len(full), len(families) + len(pairs)))
    if len(full):
        targets[:, : len(families)] = np.where(family[own][:, None] == np.arange(len(families)), 1, -1)
    for k, (a, b) in enumerate(pairs, len(families)):
        targets[own == a, k], targets[own == b, k] = 1, -1
    rng = np.random.default_rng(settings.seed)
    weights = np.zeros((settings.buckets, targets.shape[1]))
    steps = np.full_like(weights, 1e-8)
    bias, bias_steps = np.zeros(targets.shape[1]), np.full(targets.shape[1], 1e-8)
    balance = np.where(targets > 0, 0.5 / np.maximum((targets > 0).sum(0), 1), 0.5 / np.maximum((targets < 0).sum(0), 1)) * len(full)
    for _ in range(settings.epochs):
        for k in rng.permutation(len(full)):
            ids, share = buckets[full[k]], shares[full[k]] * 10
            margin = share @ weights[ids] + bias
            push = np.where(targets[k] * margin < 1, targets[k] * np.minimum(balance[k], 10), 0)
            if push.any():
                grad = share[:, None] * push - settings.shrink * weights[ids]
                steps[ids] += grad**2
                weights[ids] += settings.rate * 0.2 * grad / np.sqrt(steps[ids])
                bias_steps += push**2
                bias += settings.rate * 0.2 * push / np.sqrt(bias_steps)
    return Model(languages, families, pairs, (weights * 10).astype(np.float32), bias, settings)


class Predictor:
    def __init__(self, model: Model):
        self.model = model
        self.family = np.array([model.families.index(family_of(x)) for x in model.languages], np.int64)
        self.table = words.WordTable(self._features)

    def _features(self, new: list[bytes]) -> np.ndarray:
        owner, buckets = words.subword_buckets(new, self.model.settings.ngrams, self.model.settings.buckets)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        sums = np.add.reduceat(self.model.weights[buckets], starts, axis=0)
        return np.column_stack([sums, np.bincount(owner, minlength=len(new))]).astype(np.float32)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        model = self.model
        letters = np.array([bool(text and _LETTER.search(text)) for text in texts], bool)
        if not model.languages or not letters.any():
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        flat, counts = self.table.lookup(texts)
        sums = words.sums_by_text(self.table.rows[flat], counts)
        margins = sums[:, :-1] / np.maximum(sums[:, -1:], 1) + model.bias
        families = len(model.families)
        share = _softmax(2 * margins[:, :families])
        votes, pull = np.zeros((2, len(texts), len(model.languages)))
        for k, (a, b) in enumerate(model.pairs, families):
            margin = margins[:, k]
            votes[:, a] += margin >= 0
            votes[:, b] += margin < 0
            pull[:, a] += margin
            pull[:, b] -= margin
        chosen_family = share.argmax(axis=1)
        inside = self.family[None, :] == chosen_family[:, None]
        # Votes decide, margins break ties.
        rank = np.where(inside, votes + 0.5 * np.tanh(pull) / 2, -np.inf)
        chosen = rank.argmax(axis=1)
        within = _softmax(np.where(inside, 2 * pull, -np.inf))
        rows = np.arange(len(texts))
        score = share[rows, chosen_family] * within[rows, chosen]
        names = [model.languages[k] if has else UNDETERMINED for k, has in zip(chosen, letters)]
        return names, np.where(letters, score, 0.0)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            for part in words.slices(batch, "text"):
                names, score = predictor(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return words.texts_of(docs).mapInArrow(run, "doc_id bigint, lang_pred string, score double")
