"""Writing dimensions, the alert log and the hourly rollup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadledger import schemas
from roadledger.operators.hourly import BUCKET
from roadledger.session import path_exists
from roadledger.sources.layers import Layered


def only_new(
    new: DataFrame, existing: DataFrame, key: Sequence[str], first_by: Sequence[str] = ()
) -> DataFrame:
    """Rows whose key is not stored yet; of several new rows with one key the first is kept.

    A key that is null never conflicts, as in a unique constraint.
    """
    keyed = F.lit(True)
    for name in key:
        keyed = keyed & F.col(name).isNotNull()
    order = [F.asc(name) for name in (first_by or [n for n in new.columns if n not in key] or key)]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    first = new.filter(keyed).withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    return first.join(existing.select(*key), list(key), "left_anti").unionByName(
        new.filter(~keyed)
    )


def insert_if_absent(new: DataFrame, path: str, key: Sequence[str], first_by=()) -> None:
    """Append the rows whose key is not stored yet; running it again adds nothing."""
    spark = new.sparkSession
    if path_exists(spark, path):
        new = only_new(new, spark.read.parquet(path), key, first_by)
    else:
        new = only_new(new, new.limit(0), key, first_by)
    new.write.mode("append").parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Plain append; Spark writes one file per task, whatever the row count."""
    rows.write.mode("append").parquet(path)


def replace_buckets(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """The rollup after an upsert: fresh rows take the place of stored rows with their key."""
    kept = existing.join(fresh.select(*BUCKET), list(BUCKET), "left_anti")
    return kept.unionByName(fresh)


def rollup_table(path: str) -> Layered:
    return Layered(path, BUCKET, "bucket_date", ("fleet_id", "hour_bucket"))


def upsert_rollup(fresh: DataFrame, path: str, writer: str, number: int = 0, compact_after: int = 32) -> bool:
    """Insert fresh buckets or overwrite the stored ones with the same key.

    Only the fresh rows are written, as one change of ``writer``; readers see them in place of the
    stored ones. A number that is in already changes nothing, so a job that is run again, or died
    before its change was committed, is simply called again. Every ``compact_after`` changes the
    touched dates are folded into the base.
    """
    table = rollup_table(path)
    done = table.append(fresh, writer, number)
    if done:
        table.compact(fresh.sparkSession, fresh.schema, compact_after)
    return done


def read_rollup_table(spark: SparkSession, path: str, key: T.DataType = T.StringType()) -> DataFrame:
    """The stored rollup, each bucket once; empty if nobody has written it."""
    return rollup_table(path).read(spark, schemas.hourly(key))
