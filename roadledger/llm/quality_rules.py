"""Quality rules: word statistics, two fixed rules, and robust multivariate outliers.

Statistics of a text become a vector (log word count, mean word length, square roots of the shares
of symbols, repeated words and repeated lines). Per language and source a minimum covariance
determinant estimate of centre and spread is found by concentration steps: from medians and spreads
of the single statistics, each step takes mean and covariance of the ``core`` share of documents that
lie nearest, and measures all again. The last distances are scaled so that their median is that of
the chi-square distribution, and documents beyond ``cutoff`` are rejected.

Sources with fewer than ``least_rows`` documents of a language share one estimate per language; where
even these are too few, the fixed rules alone decide. ``floors`` keep a statistic that hardly varies
(most texts have no symbols, say) from making every other value an outlier.

Everything is DataFrame functions. Vectors are whole numbers (ten-thousandths), sums are exact, and
quantiles come from counts per narrow bin, so results do not depend on how rows are spread. A step
shuffles partial sums and bin counts per group, never rows: a source that holds most documents
costs no more than others. Estimates (a row per group) are written and joined as Spark finds fit.

Defined results: null and empty texts have no words, fail the fixed rules and take no part in
estimates. Null languages and sources count as empty names. Repeated rows are judged one by one; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadledger.session import shared_dir, written

LEAST_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\x0c\r"
UNIT = 10_000
# Positions of words need 24 bits, which leaves 39 for a hash; two hashes are used.
PLACE_BITS, HASH_BITS = 24, 39
STATISTICS = ("v_words", "v_length", "v_symbols", "v_repeats", "v_lines")
# Median of the chi-square distribution with as many degrees of freedom as there are statistics.
CHI_SQUARE_MEDIAN = 4.3515


@dataclass(frozen=True)
class Settings:
    core: float = 0.75
    steps: int = 3
    cutoff: float = 110.0
    least_rows: int = 100
    floors: tuple[float, ...] = (0.5, 0.4, 0.05, 0.25, 0.4)


def _repeated_places(numbers: str) -> Column:
    """Places of the windows whose hash some other window has, from a sorted array of packed numbers."""
    hashed = lambda x: F.shiftright(x, PLACE_BITS)
    at = lambda i: F.get(F.col(numbers), i)
    same = lambda x, other: F.coalesce(hashed(x) == hashed(other), F.lit(False))
    marked = F.transform(
        F.col(numbers), lambda x, i: F.when(same(x, at(i - 1)) | same(x, at(i + 1)), x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    )
    return F.filter(marked, lambda x: x.isNotNull())


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    frame = docs.withColumn("qr_words", F.filter(F.split(text, SPACE, -1), lambda w: w != ""))
    frame = frame.withColumn("qr_lines", F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(BLANK)) != ""))
    count = F.size("qr_words")
    word = lambda i: F.get(F.col("qr_words"), i)

    def windows(seed: int) -> Column:
        """Hashes of all windows of three words."""
        starts = F.when(count >= 3, F.sequence(F.lit(0), count - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.lit(seed), word(i), word(i + 1), word(i + 2)))

    def packed(hashes: Column) -> Column:
        mask = (1 << HASH_BITS) - 1
        return F.sort_array(
            F.transform(hashes, lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(mask)), PLACE_BITS).bitwiseOR(i.cast("bigint")))
        )

    none = F.array().cast("array<bigint>")
    frame = frame.select(
        *(docs[name] for name in docs.columns if name != "text"),
        count.cast("bigint").alias("n_words"),
        F.char_length(F.array_join("qr_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.size("qr_lines").cast("bigint").alias("n_lines"),
        (F.size("qr_lines") - F.size(F.array_distinct("qr_lines"))).cast("bigint").alias("n_dup_lines"),
        windows(1).alias("qr_first"),
        "qr_words",
    )
    # Texts without a repeated window, most of them, stop here.
    repeats = F.size(F.array_distinct("qr_first")) < F.size("qr_first")
    frame = frame.withColumn("qr_repeats", repeats)
    frame = frame.withColumn("qr_one", F.when(F.col("qr_repeats"), packed(F.col("qr_first"))))
    frame = frame.withColumn("qr_two", F.when(F.col("qr_repeats"), packed(windows(2))))
    frame = frame.withColumn("qr_places", F.array_intersect(_repeated_places("qr_one"), _repeated_places("qr_two")))
    covered = F.flatten(F.transform("qr_places", lambda p: F.array(p, p + 1, p + 2)))
    number = F.when(F.col("qr_repeats"), F.size(F.array_distinct(covered))).otherwise(F.lit(0))
    return frame.withColumn("n_repeat_words", number.cast("bigint")).drop(
        "qr_words", "qr_first", "qr_repeats", "qr_one", "qr_two", "qr_places"
    )


def _vector() -> dict[str, Column]:
    share = lambda part, whole: F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    values = (
        F.log1p(F.col("n_words").cast("double")),
        F.least(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)), F.lit(100.0)),
        share("n_symbols", "word_chars"),
        share("n_repeat_words", "n_words"),
        share("n_dup_lines", "n_lines"),
    )
    return {name: F.round(value * UNIT).cast("bigint") for name, value in zip(STATISTICS, values)}


def _grouped(rows: DataFrame, settings: Settings) -> DataFrame:
    """``rows`` with qr_lang and qr_source, the group whose estimate judges them (null: none)."""
    counts = rows.filter("n_words > 0").groupBy("qr_lang", "qr_source").agg(F.count("*").alias("held"))
    own = F.when(F.col("held") >= settings.least_rows, F.col("qr_source"))
    small = counts.withColumn("own", own)
    pooled = small.filter(F.col("own").isNull()).groupBy("qr_lang").agg(F.sum("held").alias("pooled"))
    small = small.join(pooled, "qr_lang", "left")
    group = F.when(F.col("own").isNotNull(), F.concat(F.lit("source "), "own")).when(
        F.col("pooled") >= settings.least_rows, F.lit("other sources")
    )
    return small.select("qr_lang", "qr_source", group.alias("qr_group"))


def _quantiles(rows: DataFrame, keys: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """Smallest ``value`` (a whole number) with at least the given share of a group's rows up to it."""
    bins = rows.groupBy(*keys, value.alias("qr_value")).agg(F.count("*").alias("qr_n"))
    up_to = Window.partitionBy(*keys).orderBy("qr_value")
    bins = bins.withColumn("qr_up_to", F.sum("qr_n").over(up_to)).withColumn("qr_all", F.sum("qr_n").over(Window.partitionBy(*keys)))
    return bins.groupBy(*keys).agg(
        *(F.min(F.when(F.col("qr_up_to") >= F.col("qr_all") * share, F.col("qr_value"))).alias(name) for name, share in shares.items())
    )


# Distances are binned by their logarithm, 50 bins to a factor of e.
def _distance_bin(distance: Column) -> Column:
    return F.floor(F.log(distance + 1e-6) * 50).cast("bigint")


GROUP = ["qr_lang", "qr_group"]
# Bins of a single statistic, in its units: fine enough for a start.
START_BIN = 100


def _start(rows: DataFrame, settings: Settings) -> DataFrame:
    """Medians and spreads (of the middle half) of the single statistics, as a first estimate."""
    long = rows.select(*GROUP, F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.floor(F.col(n) / START_BIN).cast("bigint").alias("value")) for i, n in enumerate(STATISTICS)))).alias("s"))
    found = _quantiles(long.select(*GROUP, "s.at", "s.value"), [*GROUP, "at"], F.col("value"), {"low": 0.25, "middle": 0.5, "high": 0.75})
    columns = []
    for i, _ in enumerate(STATISTICS):
        pick = lambda name, i=i: F.max(F.when(F.col("at") == i, F.col(name)))
        spread = (pick("high") - pick("low")) * START_BIN / 1.349
        columns.append(((pick("middle") + F.lit(0.5)) * START_BIN).alias(f"m{i}"))
        for j in range(i):
            columns.append(F.lit(0.0).alias(f"l{i}{j}"))
        columns.append(F.greatest(spread, F.lit(settings.floors[i] * UNIT)).alias(f"l{i}{i}"))
    return found.groupBy(*GROUP).agg(*columns)


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution with the triangular factor."""
    total, solved = F.lit(0.0), []
    for i, name in enumerate(STATISTICS):
        rest = F.col(name) - F.col(f"m{i}")
        for j, z in enumerate(solved):
            rest = rest - F.col(f"l{i}{j}") * z
        solved.append(rest / F.col(f"l{i}{i}"))
        total = total + solved[-1] * solved[-1]
    return total


def _estimate(core: DataFrame, settings: Settings) -> DataFrame:
    """Mean and triangular factor of the covariance (plus floors) of each group's core."""
    p = range(len(STATISTICS))
    exact = lambda c: F.sum(c.cast("decimal(38,0)")).cast("double")
    sums = core.groupBy(*GROUP).agg(
        F.count("*").cast("double").alias("n"),
        *(exact(F.col(STATISTICS[i])).alias(f"s{i}") for i in p),
        *(exact(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"s{i}{j}") for i in p for j in range(i + 1)),
    )
    frame = sums.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in p})
    for i in p:
        for j in range(i + 1):
            value = F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
            if i == j:
                value = value + F.lit((settings.floors[i] * UNIT) ** 2)
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(value, F.lit(1.0))) if i == j else value / F.col(f"l{j}{j}")
            frame = frame.withColumn(f"l{i}{j}", value)
    return frame.select(*GROUP, *(f"m{i}" for i in p), *(f"l{i}{j}" for i in p for j in range(i + 1)))


def verdicts(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept).

    ``distance``: scaled squared distance, null where no estimate judges the row.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "quality-rules")
    name = lambda column: F.coalesce(F.col(column).cast("string"), F.lit("")).alias(f"qr_{column}")
    rows = statistics(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", name("lang"), name("source")))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    rows = written(rows.withColumns({**_vector(), "base_failed": failed}), f"{folder}/statistics")
    groups = written(_grouped(rows, settings), f"{folder}/groups")
    rows = rows.join(groups, ["qr_lang", "qr_source"], "left")
    judged = rows.filter(F.col("qr_group").isNotNull() & (F.col("n_words") > 0))
    estimate = written(_start(judged, settings), f"{folder}/estimate-0")
    for step in range(1, settings.steps + 1):
        measured = judged.join(estimate, GROUP).withColumn("qr_bin", _distance_bin(_distance()))
        near = written(_quantiles(measured, GROUP, F.col("qr_bin"), {"limit": settings.core}), f"{folder}/limit-{step}")
        core = measured.join(near, GROUP).filter(F.col("qr_bin") <= F.col("limit"))
        estimate = written(_estimate(core, settings), f"{folder}/estimate-{step}")
    measured = judged.join(estimate, GROUP).withColumn("qr_bin", _distance_bin(_distance()))
    middle = written(_quantiles(measured, GROUP, F.col("qr_bin"), {"middle": 0.5}), f"{folder}/middle")
    estimate = estimate.join(middle, GROUP).withColumn("qr_scale", F.lit(CHI_SQUARE_MEDIAN) / F.exp((F.col("middle") + 0.5) / 50))
    found = rows.join(written(estimate, f"{folder}/estimate"), GROUP, "left").withColumn(
        "distance", F.when(F.col("n_words") > 0, _distance() * F.col("qr_scale"))
    )
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= settings.cutoff, F.lit(True))).alias("kept"),
    )
