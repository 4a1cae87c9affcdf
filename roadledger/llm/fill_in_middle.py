"""Fill-in-the-middle transformation by counted quantifiers.

A text is cut into units (code points, or another regular-expression atom). ``regexp_count`` counts
them, two hashes of the id choose the cuts a <= b, and a pattern made for the row, a possessive
``unit{a}`` and ``unit{b-a}`` with the rest behind, captures prefix, middle and suffix in one match
that writes the output at once. Possessive quantifiers never go back, so the match is one walk over
the text, with a stack that does not depend on its length.

Counting holds one string per match, so units are counted in blocks and only those behind the last
full block one by one: a text of any length costs about one more copy of itself.

Everything is JVM functions on one row at a time: no shuffle, no Python.

Defined results: a null or empty text is plain and empty; a text that holds a marker is plain; a
null id is hashed as an empty one; repeated rows are cut alike and each returned; an empty table
gives an empty result; only the id and the text are read, whatever else the table carries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger.llm.markers import as_replacement, checked, quoted
from roadledger.llm.text import texts_of

BLOCK = 1024
OUTPUT = "doc_id", "n", "form", "prefix_units", "middle_units", "output"


@dataclass(frozen=True)
class Settings:
    """``unit`` is one atom of a regular expression that takes one character at least, such as
    ``.`` or ``\\X``; what is left when no more units fit belongs to the suffix.

    Of 100 texts ``plain_percent`` stay as they are; of the others ``spm_percent`` in 100 get the
    suffix first.
    """

    seed: str = "1"
    unit: str = "."
    plain_percent: int = 10
    spm_percent: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        checked(self.prefix, self.suffix, self.middle)

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def units(text: Column, unit: str = ".") -> Column:
    """Number of units from the start of a text."""
    full = F.lit(f"(?s){unit}{{{BLOCK}}}+")
    rest = F.regexp_replace(text, F.lit(rf"(?s)\A(?:{unit}{{{BLOCK}}}+)*+"), F.lit(""))
    return (F.regexp_count(text, full) * BLOCK + F.regexp_count(rest, F.lit(f"(?s){unit}"))).cast("bigint")


def _hash_numbers(seed: str, key: Column) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed, colon and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def transformed(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output) of every row.

    ``form`` is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle); the counts are
    null for plain rows.
    """
    h1, h2, h3, h4 = _hash_numbers(settings.seed, F.col("doc_id"))
    holds_marker = F.lit(False)
    for marker in settings.markers:
        holds_marker |= F.contains("text", F.lit(marker))
    plain = (F.col("text") == "") | holds_marker | (h3 % 100 >= 100 - settings.plain_percent)
    form = F.when(plain, "plain").when(h4 % 100 < settings.spm_percent, "spm").otherwise("psm")
    ends = [h % (F.col("n") + 1) for h in (h1, h2)]
    cut = F.col("form") != "plain"
    pattern = F.concat(
        F.lit(rf"(?s)\A({settings.unit}{{"), F.col("prefix_units").cast("string"),
        F.lit(f"}}+)({settings.unit}{{"), F.col("middle_units").cast("string"), F.lit(r"}+)(.*+)\z"),
    )
    p, s, m = map(as_replacement, settings.markers)
    order = F.when(F.col("form") == "spm", F.lit(f"{s}$3{p}$1{m}$2")).otherwise(F.lit(f"{p}$1{s}$3{m}$2"))
    return (
        texts_of(docs)
        .select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .select("*", units(F.col("text"), settings.unit).alias("n"), form.alias("form"))
        .select("*", F.when(cut, F.least(*ends)).alias("prefix_units"), F.when(cut, F.greatest(*ends)).alias("middle_end"))
        .select("*", (F.col("middle_end") - F.col("prefix_units")).alias("middle_units"))
        .select("*", F.when(cut, F.regexp_replace("text", pattern, order)).otherwise(F.col("text")).alias("output"))
        .select(*OUTPUT)
    )


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text a transformed row was made from.

    Neither the texts cut nor their joints hold a marker, so the first of each is the one put in.
    """
    p, s, m = map(quoted, settings.markers)
    psm = F.regexp_replace(output, F.lit(rf"(?s)\A{p}(.*?){s}(.*?){m}(.*+)\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(rf"(?s)\A{s}(.*?){p}(.*?){m}(.*+)\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
