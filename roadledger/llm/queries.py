"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadledger.llm import (
    chat,
    decontaminate,
    fill_in_middle,
    language,
    lexical,
    line_dedup,
    minhash,
    packing,
    quality_classifier,
    quality_rules,
    secret_scan,
    substring,
    toxicity,
)
from roadledger.llm.text import remainder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

QUALITY_THRESHOLD = 0.3
TOXIC_THRESHOLD = 0.5
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), "quality")
    return quality_classifier.scores(docs, model).select(
        "doc_id",
        (remainder("doc_id", quality_classifier.HELD_OUT_MODULUS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts of the base kinds, their digest, and all spans."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    named = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    kinds = [rule.kind for rule in secret_scan.BASE_RULES]
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select(
        "doc_id",
        *(of(kind).alias(f"n_{kind}") for kind in kinds),
        F.sha2(F.array_join(F.transform(base, named), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", named), ",").alias("spans"),
    )


@query
def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document, on 2-word shingles."""
    return minhash.components(table(spark, sf_dir, "documents"), minhash.Settings(shingle=2))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document left when repeated passages are removed."""
    return substring.kept_texts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    return language.predictions(docs, language.fit(docs)).select(
        "doc_id",
        (remainder("doc_id", language.HELD_OUT_MODULUS) == language.HELD_OUT).alias("held_out"),
        "lang_pred",
        "score",
    )


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), packing.Settings(TOKENIZER))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic")
    return toxicity.scores(docs, model).select(
        "doc_id",
        (remainder("doc_id", toxicity.HELD_OUT_MODULUS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those that are boilerplate of its source, and what stays."""
    return line_dedup.marked(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("line_dedup_lines").alias("n_lines"),
        F.col("line_dedup_dropped").alias("n_dropped"),
        F.sha2("line_dedup_text", 256).alias("kept_sha256"),
    )


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, fixed rules and the robust outlier verdict."""
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that every document holds."""
    docs = table(spark, sf_dir, "documents")
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return (
        docs.select("doc_id")
        .join(found, "doc_id", "left")
        .select(
            "doc_id",
            F.col("items").isNotNull().alias("contaminated"),
            F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
            F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("item_ids"),
            F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        )
    )


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its fill-in-the-middle form, and the text read back from it."""
    cut = fill_in_middle.transformed(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


# A conversation whose texts hold the template's own control strings.
CONTROL_CONVERSATION = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


@query
def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and read back from its formatted text and loss mask."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame(CONTROL_CONVERSATION, "conv_id bigint, turn bigint, role string, text string")
    done = chat.formatted(chat.linear(said.unionByName(own)))
    spoken = F.transform(chat.turns_of(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = done.select(
        F.col("tree").alias("conv_id"),
        spoken.alias("spoken"),
        F.array_join(chat.trained_texts(F.col("text"), F.col("loss")), "").alias("learnt"),
        F.char_length("text").cast("bigint").alias("formatted_chars"),
    )
    return read.select(
        "conv_id",
        F.size("spoken").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join("spoken", ""), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    found = lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
