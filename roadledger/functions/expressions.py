"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadledger.schemas import RAW_DECIMAL, SPEED

ZONED = (
    r"^\d{4}-\d{2}-\d{2}[tT _]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)? ?([zZ]|[+-]\d{2}:?\d{2})$"
)
EPOCH_NUMBER = r"^[+-]?\d{1,15}(\.\d+)?$"
# Numbers beyond this are milliseconds, others seconds; years 1 to 9999 can be stored.
MOST_SECONDS = 20_000_000_000
YEARS = (-62_135_596_800_000_000, 253_402_300_799_999_999)


def exact_mean(total: Column, n: Column) -> Column:
    """``total / n`` rounded once, half up, to two decimals; null for no rows.

    ``avg`` over decimal(6,2) already rounds to six decimals, so rounding its result rounds
    twice. A decimal quotient with 23 decimals keeps the single rounding exact.
    """
    quotient = total / F.nullif(n, F.lit(0)).cast("decimal(20,0)")
    return F.round(quotient, 2).cast(SPEED)


def mean_of(value: str) -> Column:
    """Exact mean of a decimal(6,2) column, as an aggregate."""
    return exact_mean(F.sum(value), F.count(value))


def hour_of(column: str = "recorded_at") -> Column:
    return F.date_trunc("hour", F.col(column))


def instant_of(value: Column) -> Column:
    """A zone-aware instant from text; null for text without an offset or without a readable time.

    A plain number counts seconds since 1970, or milliseconds if it is too large for that.
    """
    text = F.trim(value)
    usual = text.try_cast("timestamp")
    # Spellings the cast does not read: separators, lower-case letters, offsets without colon.
    plain = F.concat(F.substring(text, 1, 10), F.lit("T"), F.upper(F.substring(text, 12, 40)))
    plain = F.regexp_replace(plain, r" ?([+-]\d{2}):?(\d{2})$", "$1:$2")
    spelled = F.regexp_replace(plain, r"^(.{13}:\d{2})(Z|[+-]\d{2}:\d{2})$", "$1:00$2")
    number = text.try_cast(RAW_DECIMAL)
    micros = F.round(number * F.when(F.abs(number) > MOST_SECONDS, 1_000).otherwise(1_000_000)).try_cast("bigint")
    counted = F.when(micros.between(*YEARS), F.timestamp_micros(micros))
    return F.when(text.rlike(ZONED), F.coalesce(usual, spelled.try_cast("timestamp"))).when(text.rlike(EPOCH_NUMBER), counted)


def month_of(column: str = "recorded_at") -> Column:
    return F.date_format(F.col(column), "yyyy-MM")


def battery_band(column: str = "battery_level") -> Column:
    """Below 15 is low, below 30 is mid, the rest is high."""
    level = F.col(column)
    return F.when(level < 15, "low").when(level < 30, "mid").otherwise("high")


def label_text(column: str) -> Column:
    return F.replace(F.col(column), F.lit("_"), F.lit(" "))


def key_digest(column: str) -> Column:
    """SHA-256 hex digest of an API key."""
    return F.sha2(F.col(column), 256)


def row_id(*scope: str) -> Column:
    """An id in UUID form, from the scope (a job, a batch) and the row's place in the table.

    ``uuid()`` carries a fresh seed into the generated code, so every batch of a stream would be
    compiled anew; text literals do not change the code.
    """
    place = F.monotonically_increasing_id().cast("string")
    digest = F.md5(F.concat_ws("/", *[F.lit(part) for part in scope], place))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def iso_time(column: str) -> Column:
    """ISO-8601 text in UTC; the fraction is written only when there is one."""
    instant = F.col(column)
    fraction = F.date_format(instant, ".SSSSSS")
    return F.concat(
        F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == ".000000", "").otherwise(fraction),
        F.lit("+00:00"),
    )


def json_ready(df: DataFrame) -> DataFrame:
    """Decimals as doubles and times as ISO-8601 text, as a JSON reply shows them."""
    columns = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.DecimalType):
            columns.append(F.col(field.name).cast("double").alias(field.name))
        elif isinstance(field.dataType, T.TimestampType):
            columns.append(iso_time(field.name).alias(field.name))
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)


def to_json_rows(df: DataFrame, column: str = "json") -> DataFrame:
    """One JSON object per row; null fields are written as null."""
    ready = json_ready(df)
    return ready.select(
        F.to_json(F.struct(*ready.columns), {"ignoreNullFields": "false"}).alias(column)
    )
