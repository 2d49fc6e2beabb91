"""A keyed table whose updates are small files, folded in when it is read.

A table is a log of versions. Each version names the folders that make it up: a base, in ranges of the key, and updates after it with
their policies. Appending writes the updates alone; a reader folds those of a key in the order of versions. ``compact`` writes a new base.

A version is published by renaming a whole file to the next number, which fails if another writer has it: that writer then builds
on what the other published. Updates need no knowledge of the base, so they are only moved behind the other's; a
compaction gives up if another has replaced what it read. Nothing that a version names is ever overwritten.
A writer that numbers its batches may send one again: it is left out if it is in the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.operators.commit_log import CommitLog
from corvane.scratch import delete, file_system

#: Updates that a reader folds at most before ``append`` compacts.
MAX_UPDATES = 16


class Conflict(RuntimeError):
    """Another writer replaced what this one built on."""


@dataclass(frozen=True)
class Policy:
    """What an update does to a known key: ``columns`` are overwritten (all that it has, if None), unless the row that is there is newer by
    ``order``; with ``keep_known`` the row stays as it is. An unknown key is a new row, unless ``known_only``."""

    given: tuple[str, ...]
    columns: tuple[str, ...] | None = None
    known_only: bool = False
    keep_known: bool = False
    order: tuple[str, ...] = ()

    def writes(self, column: str) -> bool:
        return not self.keep_known and column in (self.given if self.columns is None else self.columns)


@dataclass(frozen=True)
class Version:
    number: int = -1
    base: str | None = None
    updates: tuple[tuple[str, Policy], ...] = ()
    #: The last batch of each writer that numbers them.
    batches: dict[str, int] = field(default_factory=dict)
    key: tuple[str, ...] = ()


class KeyedTable:
    """``schema`` is that of all columns; ``key`` names those that tell rows apart (none of them null)."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: list[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.log = CommitLog(spark, f"{self.path}/log")

    # --- the log

    def version(self, number: int | None = None) -> Version:
        """A published version, the last one if none is named."""
        number, text = self.log.last() if number is None else (number, self.log.read(number))
        if text is None:
            return Version()
        raw = json.loads(text)
        updates = tuple((p, Policy(**{k: tuple(v) if isinstance(v, list) else v for k, v in policy.items()})) for p, policy in raw["updates"])
        return Version(number, raw["base"], updates, raw["batches"], tuple(raw["key"]))

    def _publish(self, version: Version) -> bool:
        return self.log.publish(version.number, json.dumps(asdict(version)))

    def _commit(self, change: Callable[[Version], Version | None]) -> Version:
        """Publish what ``change`` makes of the last version, again if another writer was first."""
        while True:
            now = self.version()
            new = change(now)
            if new is None:
                return now
            new = replace(new, number=now.number + 1, key=tuple(self.key))
            if self._publish(new):
                return new

    # --- writing

    def _written(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        writer = rows.write
        if kind == "base":  # lookups by key skip its files by range, or by filter
            writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
            for k in self.key:
                writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        writer.parquet(f"{self.path}/{name}")
        return name

    def append(self, updates: DataFrame, policy: Policy | None = None, writer: str | None = None, batch: int = 0) -> Version:
        """Add updates (unique by key); ``writer`` and ``batch`` name a batch that may come twice."""
        if writer is not None and self.version().batches.get(writer, -1) >= batch:
            return self.version()
        names = [c for c in self.schema.names if c in updates.columns]
        policy = replace(policy, given=tuple(names)) if policy else Policy(tuple(names))
        name = self._written(updates.select(*[F.col(c).cast(self.schema[c].dataType).alias(c) for c in names]), "update")

        def add(now: Version) -> Version | None:
            if writer is not None and now.batches.get(writer, -1) >= batch:
                return None
            return replace(now, updates=(*now.updates, (name, policy)), batches=now.batches | ({} if writer is None else {writer: batch}))

        done = self._commit(add)
        if len(done.updates) > MAX_UPDATES:
            try:
                return self.compact()
            except Conflict:
                pass
        return done

    def compact(self) -> Version:
        """A new base of all that the last version has."""
        start = self.version()
        if not start.updates:
            return start
        rows = self.read(start.number)
        name = self._written(rows.repartitionByRange(*self.key).sortWithinPartitions(*self.key), "base")

        def swap(now: Version) -> Version:
            if now.base != start.base or now.updates[: len(start.updates)] != start.updates:
                delete(self.spark, f"{self.path}/{name}")
                raise Conflict(f"{self.path}: version {now.number} no longer has what version {start.number} had")
            return replace(now, base=name, updates=now.updates[len(start.updates) :])

        return self._commit(swap)

    def vacuum(self) -> None:
        """Delete what only older versions name; to be called while nobody reads those or writes."""
        now = self.version()
        used = {now.base, *(p for p, _ in now.updates), "log"}
        files, at = file_system(self.spark, self.path)
        for s in files.listStatus(at) if files.exists(at) else []:
            if s.getPath().getName() not in used:
                files.delete(s.getPath(), True)
        self.log.forget(now.number)

    # --- reading

    def _part(self, name: str, names: list[str]) -> DataFrame:
        kind = StructType([self.schema[c] for c in names])
        return self.spark.read.schema(kind).parquet(f"{self.path}/{name}")

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version. Rows of the base without an update pass as they are; the keys of updates alone are brought together."""
        version, names = self.version(number), self.schema.names
        base = self._part(version.base, names) if version.base else self.spark.createDataFrame([], self.schema)
        if not version.updates:
            return base
        parts = [self._part(name, list(policy.given)).withColumn("_nth", F.lit(i)) for i, (name, policy) in enumerate(version.updates)]
        updates = parts[0]
        for p in parts[1:]:
            updates = updates.unionByName(p, allowMissingColumns=True)
        touched = updates.select(*self.key).distinct()
        known = base.join(touched, self.key, "left_semi").withColumn("_nth", F.lit(-1))
        rest = [c for c in names if c not in self.key]
        rows = known.unionByName(updates, allowMissingColumns=True)
        folded = rows.groupBy(*self.key).agg(_fold([p for _, p in version.updates], rest).alias("_row")).where("_row is not null")
        return base.join(touched, self.key, "left_anti").unionByName(folded.select(*self.key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*names))


def _fold(policies: list[Policy], columns: list[str]) -> Column:
    """The row of a key: its base row (update -1), and each update in turn."""
    found = F.array_sort(F.collect_list(F.struct("_nth", *columns)))
    values = F.struct(*columns)

    def step(row: Column, x: Column) -> Column:
        nth = x["_nth"]
        among = lambda test: nth.isin([i for i, p in enumerate(policies) if test(p)])
        older = F.lit(False)
        for i, p in enumerate(policies):
            if p.order:
                at = lambda r, p=p: F.struct(*[r[c].alias(c) for c in p.order])
                older = older | ((nth == i) & (at(x) < at(row)))
        after = F.struct(*[F.when(among(lambda p, c=c: p.writes(c)), x[c]).otherwise(row[c]).alias(c) for c in columns])
        new = F.struct(*[x[c].alias(c) for c in columns])
        return F.when(row.isNull(), F.when(~among(lambda p: p.known_only), new)).otherwise(F.when(older, row).otherwise(after))

    # a null of the rows' type to start from
    return F.aggregate(found, F.when(F.lit(False), F.any_value(values)), step)
