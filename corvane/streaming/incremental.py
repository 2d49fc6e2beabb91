"""Incremental ingestion: a file stream drained once, folded into snapshots, with a watermark.

Each run reads what is new since its checkpoint (``availableNow``), so it can be cut short and started again.
A micro-batch is an update of a keyed table: its own rows alone are written, and a batch that comes twice counts once. Tables and
watermarks are published by a commit log, so two writers never undo each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.commit_log import CommitLog
from corvane.operators.keyed_table import KeyedTable, Policy, Version
from corvane.operators.upsert import latest


class Snapshots:
    """Snapshots of a keyed table under one folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def current(self) -> DataFrame:
        version = KeyedTable(self.spark, self.path, self.schema, []).version()
        return KeyedTable(self.spark, self.path, self.schema, list(version.key)).read(None if version.number < 0 else version.number)

    def fold(self, updates: DataFrame, key: list[str], order: list[str], version: int, update_cols: list[str] | None = None, writer: str = "fold") -> Version:
        """The newest row of each key, unless the one that is there is newer; ``writer`` numbers its batches by ``version``."""
        table = KeyedTable(self.spark, self.path, self.schema, key)
        newest = latest(updates.select(*table.schema.names), key, order)
        policy = Policy((), None if update_cols is None else tuple(update_cols), order=tuple(order))
        return table.append(newest, policy, writer, version)


def ingest(spark: SparkSession, source: str, schema: str, snapshots: Snapshots, key: list[str], order: list[str], checkpoint: str, max_files: int = 100, pattern: str = "*.parquet") -> StreamingQuery:
    """Drain the files of ``source`` whose names meet ``pattern`` and that are new into ``snapshots``; returns the finished query."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", pattern).parquet(source)

    def fold(batch: DataFrame, epoch: int) -> None:
        # the query's id is kept in its checkpoint: another checkpoint is another writer
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        snapshots.fold(batch, key, order, epoch, writer=query)

    q = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def read_watermark(spark: SparkSession, path: str) -> datetime | None:
    _, value = CommitLog(spark, path).last()
    return datetime.fromisoformat(value) if value else None


def advance_watermark(spark: SparkSession, path: str, started: datetime, aborted: int, cut_short: bool) -> bool:
    """Move the watermark to the run's start, only after a run that left nothing out, and never back: of two runs that end together the
    later start counts."""
    if aborted or cut_short:
        return False
    log = CommitLog(spark, path)
    while True:
        number, value = log.last()
        if value is not None and datetime.fromisoformat(value) >= started:
            return True
        if log.publish(number + 1, started.isoformat()):
            log.forget(number)
            return True


QUEUE = "key string, state string, result string"


def drain(rows: DataFrame, key: str, column: str, work: Callable[[list[str]], list[str]], stop_on: type[Exception], batch: int = 128) -> DataFrame:
    """key, state, result of a work queue's rows.

    ``work`` gets batches of at most ``batch`` values. Its rows are ``done``; after an error of the kind ``stop_on`` (the service is
    out) the batch and all that the task still had are ``requeued``; after another error only the batch is ``failed``, with the
    error's text as result, and the task goes on. A requeued row is one that the next run finds pending again."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = False

        def worked(some: pd.DataFrame) -> pd.DataFrame:
            nonlocal stopped
            state, results = "requeued", [None] * len(some)
            if not stopped:
                try:
                    state, results = "done", work(some[column].tolist())
                except stop_on:
                    stopped = True
                except Exception as e:  # noqa: BLE001  any other failure is the batch's own
                    state, results = "failed", [f"{type(e).__name__}: {e}"] * len(some)
            return pd.DataFrame({"key": some[key].tolist(), "state": state, "result": results})

        held = None
        for part in parts:
            held = part if held is None else pd.concat([held, part], ignore_index=True)
            while len(held) >= batch:
                yield worked(held.iloc[:batch])
                held = held.iloc[batch:]
        if held is not None and len(held):
            yield worked(held)

    return rows.select(F.col(key).cast("string").alias(key), column).mapInPandas(run, QUEUE)
