"""Line dedup by site-relative frequency.

For every host the pages that contain a line are divided by the host's pages; a line that is on
more than ``ratio`` of them (and on ``least_pages`` at least) is boilerplate there and is dropped
from all pages of that host. Pages of a host with the same text count as one page, so a page's
copies make none of its lines boilerplate. Lines are compared without spaces, tabs and carriage
returns around them; blank lines are neither counted nor dropped. A page of which no line but blank
ones would stay is left as it is: dropping whole pages is left to near-duplicate operators.

Everything is DataFrame functions. Counts are combined before each shuffle, keyed by host and line,
so a host that holds most pages is spread by its lines. A host has at most (lines per page / ratio)
boilerplate lines; the list per host is written, and joined to the pages by the join Spark finds
fit for its size.

Defined results: null texts and pages without a host are left as they are (n_lines 0 for null);
repeated rows count once and are all treated alike; an empty table gives an empty result; other
columns are carried, n_chars is counted anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger.session import shared_dir, written

BLANK = " \t\r"


@dataclass(frozen=True)
class Settings:
    ratio: float = 0.1
    least_pages: int = 5


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANK)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(pages: DataFrame, host: Column, text: Column, settings: Settings = Settings()) -> DataFrame:
    """(host, lines): hashes of the boilerplate lines of each host that has any."""
    known = pages.select(host.alias("host"), text.alias("text")).filter(F.col("host").isNotNull() & F.col("text").isNotNull())
    page = F.xxhash64("text")
    filled = F.filter(_lines(F.col("text")), lambda line: F.btrim(line, F.lit(BLANK)) != "")
    rows = known.select("host", page.alias("page"), F.explode(F.array_distinct(F.transform(filled, _key))).alias("line"))
    totals = known.select("host", page.alias("page")).groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("total"))
    per_line = (
        rows.groupBy("host", "line", "page").agg(F.lit(1).alias("one"))
        .groupBy("host", "line").agg(F.count("*").alias("pages"))
        .filter(F.col("pages") >= settings.least_pages)
    )
    return (
        per_line.join(totals, "host")
        .filter(F.col("pages") > F.col("total") * F.lit(settings.ratio))
        .groupBy("host")
        .agg(F.sort_array(F.collect_set("line")).alias("lines"))
    )


OUTPUT = "line_dedup_lines", "line_dedup_dropped", "line_dedup_text"


def _judged(pages: DataFrame, host: str, text: str, settings: Settings) -> DataFrame:
    """(row, lines, dropped, text): each page as one value, so that its names meet no others."""
    spark = pages.sparkSession
    lists = written(boilerplate(pages, F.col(host), F.col(text), settings), shared_dir(spark, "line-boilerplate"))
    rows = pages.select(F.struct("*").alias("row"), F.col(host).alias("of_host"), F.col(text).alias("text"))
    joined = rows.join(lists.select(F.col("host"), F.col("lines").alias("known")), F.col("of_host") == F.col("host"), "left")
    lines = _lines(F.col("text"))
    # Only hashes that are on this page and boilerplate here: few, so looking through them is cheap.
    here = F.when(F.col("known").isNotNull() & F.col("text").isNotNull(), F.array_intersect(F.transform(lines, _key), "known"))
    found = joined.select("row", "text", here.alias("here"))
    filled = lambda line: F.btrim(line, F.lit(BLANK)) != ""
    stays = lambda line: ~F.array_contains("here", _key(line)) | ~filled(line)
    found = found.withColumn("kept", F.when(F.size("here") > 0, F.filter(lines, stays)))
    whole = F.col("kept").isNull() | ~F.exists("kept", filled)
    total = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines))
    return found.select(
        "row",
        total.cast("bigint").alias("lines"),
        F.when(whole, F.lit(0)).otherwise(total - F.size("kept")).cast("bigint").alias("dropped"),
        F.when(whole, F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
    )


def marked(pages: DataFrame, host: str = "source", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``pages`` with columns line_dedup_lines, _dropped (counts) and _text (what stays), which take
    the place of columns of these names."""
    found = _judged(pages, host, text, settings)
    own = (F.col("row")[name].alias(name) for name in pages.columns if name not in OUTPUT)
    return found.select(*own, *(F.col(name.removeprefix("line_dedup_")).alias(name) for name in OUTPUT))


def cleaned(pages: DataFrame, host: str = "source", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``pages`` without boilerplate lines, in the same columns."""
    found = _judged(pages, host, text, settings)
    values = {text: F.col("text")}
    if "n_chars" in pages.columns:
        counted = F.when(F.col("dropped") > 0, F.char_length("text"))
        values["n_chars"] = F.coalesce(counted.cast(pages.schema["n_chars"].dataType), F.col("row")["n_chars"])
    return found.select(*(values.get(name, F.col("row")[name]).alias(name) for name in pages.columns))
