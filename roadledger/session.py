"""Spark session settings and the shared working folder."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on; everything else is left to the cluster.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Methods above 8000 bytes of bytecode are not compiled by the JVM. The ingest checks make
    # such methods; below this limit Spark splits them instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(
    app_name: str = "roadledger",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or get) a session. On a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(SESSION_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Hour buckets and month labels are UTC, whatever zone the session came with."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    A machine-local folder is made only in local mode, where there is one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    base = tempfile.mkdtemp(prefix="roadledger-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below :func:`shared_root`."""
    return os.path.join(shared_root(spark), f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, path: str, reuse: bool = False) -> DataFrame:
    """Write a table to shared storage and read it back.

    Later steps start from its files: nothing upstream is computed twice and a lost executor
    costs no more than a read. With ``reuse`` a table a former run finished is kept.
    """
    if not (reuse and is_complete(df.sparkSession, path)):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written or collected in here go as soon as it is done, not when the driver's JVM
    happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when a job finished writing ``path``."""
    return path_exists(spark, f"{path}/_SUCCESS")


def query_label(spark: SparkSession, checkpoint: str) -> str:
    """Names a streaming query by the id Spark keeps in its checkpoint.

    A restart from the same checkpoint has the same name; a fresh checkpoint has another one, so
    what was staged under an old one's batch numbers is not taken for its own.
    """
    kept = spark.read.text(f"{checkpoint}/metadata").first()[0]
    return json.loads(kept)["id"].split("-")[0]
