"""Tables kept as a base with changes on top, so that an upsert writes only its own rows.

A writer puts its rows into a change folder of their own and then commits a new version: a small
file that names the live change folders, oldest first, and the live parts of the base. Readers
take the newest version and see of rows with one key the newest. Compaction folds the changes into
new parts of the base, of the touched partitions only, and commits that. Nothing that a version
names is ever overwritten, so a writer or a compaction that dies halfway leaves files no version
names, and one that is run again starts over or finds its number already in.

Versions are committed by renaming a file to the next number, which fails if another writer was
faster; the change is then applied to that writer's version. A table has two or three files of
versions, base parts and changes per compaction; :func:`Layered.clean` removes what is no longer
named.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadledger.session import is_complete, use_utc

ATTEMPTS = 20


@dataclass(frozen=True)
class Version:
    """``base`` names parts as generation or partition/generation; ``writers`` the newest number of
    each; ``folded`` the names (see :class:`Names`) that have gone into the base for good."""

    number: int = 0
    base: list[str] = field(default_factory=list)
    changes: list[str] = field(default_factory=list)
    writers: dict[str, int] = field(default_factory=dict)
    folded: dict[str, list[list[int]]] = field(default_factory=dict)


class Conflict(RuntimeError):
    """Another compaction has replaced the parts that this one started from."""


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    where, fs = _folder(spark, path)
    return sorted(status.getPath().getName() for status in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _folder(spark, path)
    fs.delete(where, True)


class Names:
    """A set of names; those that end in a number are kept as ranges, so running numbers stay short."""

    def __init__(self, ranges: dict[str, list[list[int]]] | None = None):
        self.ranges = {prefix: [list(r) for r in known] for prefix, known in (ranges or {}).items()}

    @staticmethod
    def _split(name: str) -> tuple[str, int]:
        prefix, number = re.fullmatch(r"(.*?)(0|[1-9]\d{0,15})?", name, re.DOTALL).groups()
        return (prefix, int(number)) if number else (f"{name}\0", 0)

    def __contains__(self, name: str) -> bool:
        prefix, number = self._split(name)
        return any(low <= number <= high for low, high in self.ranges.get(prefix, ()))

    def add(self, name: str) -> None:
        if name not in self:
            prefix, number = self._split(name)
            joined: list[list[int]] = []
            for low, high in sorted([*self.ranges.get(prefix, []), [number, number]]):
                if joined and low == joined[-1][1] + 1:
                    joined[-1][1] = high
                else:
                    joined.append([low, high])
            self.ranges[prefix] = joined


class VersionLog:
    """The numbered versions of the table at ``path``."""

    def __init__(self, path: str):
        self.path = f"{path}/_versions"

    def names(self, spark: SparkSession) -> list[str]:
        return [name for name in names_in(spark, self.path) if re.fullmatch(r"\d+\.json", name)]

    def load(self, spark: SparkSession, name: str) -> Version:
        where, fs = _folder(spark, f"{self.path}/{name}")
        stream = fs.open(where)
        try:
            return Version(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def newest(self, spark: SparkSession) -> Version:
        found = self.names(spark)
        return self.load(spark, found[-1]) if found else Version()

    def commit(self, spark: SparkSession, change: Callable[[Version], Version]) -> Version:
        """Apply ``change`` to the newest version and make the result the next one."""
        for _ in range(ATTEMPTS):
            before = self.newest(spark)
            after = replace(change(before), number=before.number + 1)
            draft, fs = _folder(spark, f"{self.path}/_{uuid.uuid4().hex}")
            stream = fs.create(draft)
            stream.write(bytearray(json.dumps(asdict(after)).encode()))
            stream.close()
            final, _ = _folder(spark, f"{self.path}/{after.number:020}.json")
            context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
            none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                context.rename(draft, final, none)
                return after
            except Exception as error:
                fs.delete(draft, False)
                if not fs.exists(final):
                    raise RuntimeError(f"version {after.number} in {self.path} could not be committed") from error
        raise RuntimeError(f"{self.path}: other writers were faster {ATTEMPTS} times")


@dataclass(frozen=True)
class Layered:
    """A table at ``path``. Of rows with one ``key`` the newest change counts; without a key all do.

    With ``newest_by`` the greatest of these columns counts instead, whichever change it came with.
    ``partition`` is a column to partition by; base files are sorted by ``sort``.
    """

    path: str
    key: tuple[str, ...] = ()
    partition: str | None = None
    sort: tuple[str, ...] = ()
    newest_by: tuple[str, ...] = ()

    @property
    def log(self) -> VersionLog:
        return VersionLog(self.path)

    def append(self, rows: DataFrame, writer: str, number: int = 0) -> bool:
        """Put rows on top as the ``number``-th change of a writer; False if it (or a later one) is in.

        With a key, one change should hold a key once. A change that was written but not committed
        before its writer died is committed as it is.
        """
        spark = rows.sparkSession
        if self.log.newest(spark).writers.get(writer, -1) >= number:
            return False
        name = f"{re.sub(r'[^A-Za-z0-9_.-]', '_', writer)}-{number}"
        folder = f"{self.path}/changes/change={name}"
        if not is_complete(spark, folder):
            self._laid_out(rows).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder, partitionBy=self.partition)
        self.log.commit(
            spark,
            lambda now: replace(now, changes=[*(c for c in now.changes if c != name), name], writers={**now.writers, writer: number}),
        )
        return True

    def _laid_out(self, rows: DataFrame) -> DataFrame:
        if self.partition:
            rows = rows.hint("rebalance", F.col(self.partition))
        order = [name for name in (self.partition, *self.sort) if name]
        return rows.sortWithinPartitions(*order) if order else rows

    def _part(self, generation: str) -> Column:
        return F.concat_ws("/", F.col(self.partition).cast("string"), generation) if self.partition else F.col(generation)

    def _stored(self, spark: SparkSession, schema: T.StructType, name: str, column: str) -> DataFrame:
        own = T.StructType([f for f in schema.fields if f.name != self.partition])
        last = [schema[self.partition]] if self.partition else []
        return use_utc(spark).read.schema(T.StructType([*own.fields, *last, T.StructField(column, T.StringType())])).parquet(f"{self.path}/{name}")

    def _changes(self, spark: SparkSession, schema: T.StructType, version: Version) -> DataFrame:
        rows = self._stored(spark, schema, "changes", "change")
        return rows.filter(F.col("change").isin(version.changes))

    def read(self, spark: SparkSession, schema: T.StructType, version: Version | None = None) -> DataFrame:
        """The table as of a version, by default the newest; empty if nobody has written it.

        Only live folders are listed in the plan. The base is not shuffled for a few changes: it
        loses the keys of the changes by an anti join.
        """
        version = version or self.log.newest(spark)
        base = changes = None
        if version.base:
            base = self._stored(spark, schema, "base", "generation").filter(self._part("generation").isin(version.base)).select(*schema.names)
        if version.changes:
            changes = self._changes(spark, schema, version)
            if self.key and not self.newest_by and len(version.changes) > 1:
                order = F.array_position(F.array(*map(F.lit, version.changes)), F.col("change"))
                changes = _first(changes, self.key, [F.desc(order)])
            changes = changes.select(*schema.names)
        if base is None or changes is None:
            rows = base if changes is None else changes
            rows = use_utc(spark).createDataFrame([], schema) if rows is None else rows
        elif self.key and not self.newest_by:
            rows = base.join(changes.select(*self.key), list(self.key), "left_anti").select(*schema.names).unionByName(changes)
        else:
            rows = base.unionByName(changes)
        if self.newest_by and changes is not None:
            rows = _first(rows, self.key, [F.desc(name) for name in self.newest_by])
        return rows

    def compact(self, spark: SparkSession, schema: T.StructType, at_least: int = 1) -> bool:
        """Fold the changes into the base if there are so many; only partitions they touch are written."""
        start = self.log.newest(spark)
        if len(start.changes) < at_least:
            return False
        generation = f"{start.number}-{uuid.uuid4().hex[:8]}"
        rows = self.read(spark, schema, start)
        touched = None
        if self.partition:
            values = self._changes(spark, schema, start).select(self.partition).distinct()
            touched = [row[0] for row in values.collect()]  # one per partition folder
            rows = rows.filter(F.col(self.partition).isin(touched))
        laid = self._laid_out(rows).withColumn("generation", F.lit(generation))
        laid.write.mode("append").parquet(f"{self.path}/base", partitionBy=[*filter(None, (self.partition,)), "generation"])
        fresh = [f"{value}/{generation}" for value in touched] if self.partition else [generation]

        def replaced(version: Version) -> list[str]:
            heads = {f"{value}/" for value in touched} if self.partition else {""}
            return [part for part in version.base if any(part.startswith(head) for head in heads)]

        def folded(now: Version) -> Version:
            if replaced(now) != replaced(start):
                raise Conflict(self.path)
            kept = [part for part in now.base if part not in set(replaced(start))]
            return replace(now, base=kept + fresh, changes=[c for c in now.changes if c not in set(start.changes)])

        self.log.commit(spark, folded)
        return True

    def clean(self, spark: SparkSession, keep: int = 3) -> None:
        """Delete versions but the newest ``keep``, and the folders that none of those names.

        Not while a writer is at work whose change is not committed yet.
        """
        names = self.log.names(spark)
        live: set[str] = set()
        for version in (self.log.load(spark, name) for name in names[-keep:]):
            live |= {f"changes/change={c}" for c in version.changes}
            for part in version.base:
                value, _, generation = part.rpartition("/")
                live.add(f"base/{self.partition}={value}/generation={generation}" if value else f"base/generation={generation}")
        stored = [f"changes/{name}" for name in names_in(spark, f"{self.path}/changes")]
        for name in names_in(spark, f"{self.path}/base"):
            inner = names_in(spark, f"{self.path}/base/{name}") if self.partition and "=" in name else []
            stored += [f"base/{name}/{part}" for part in inner] or [f"base/{name}"]
        dead = [name for name in stored if "=" in name and name not in live]
        dead += [f"_versions/{name}" for name in names[:-keep]]
        for name in dead:
            delete(spark, f"{self.path}/{name}")


def _first(rows: DataFrame, key: tuple[str, ...], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
