"""Corpus pipeline: documents from quality filtering to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet
to the shared folder and hands what it reads back to the next stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadledger.llm import decontaminate, line_dedup, minhash, packing, quality_classifier
from roadledger.llm.queries import QUALITY_THRESHOLD, TOKENIZER, table
from roadledger.session import shared_dir, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), "quality")
    return quality_classifier.accepted(docs, model, QUALITY_THRESHOLD)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source."""
    return line_dedup.cleaned(docs, host="source")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8 alike)."""
    return minhash.deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return packing.pack(docs, packing.Settings(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("lines", drop_boilerplate),
    ("near copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("packing", pack),
]

# The classifiers' decisions have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), shared_dir(spark, "pipeline-" + name.replace(" ", "-")))
    return docs
