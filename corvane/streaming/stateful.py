"""Latest row of each key kept in a stream's state: a micro-batch sends what it changes, and the state knows what came late.

The state of a key is one row, held by the state store between batches and runs, so a batch costs what its own rows cost. Keys are
handled in groups, with a group's rows in columns and each key's state looked up by itself. What a
batch changes is an update of a keyed table, numbered by the batch: a batch that comes twice counts once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from corvane.operators.keyed_table import KeyedTable, Policy

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Keys are dealt to so many groups, fixed as the state is laid out by it. A task hands rows to Python group by group, which costs
#: some milliseconds each whatever it holds.
GROUPS = 1024


class Latest(StatefulProcessor):
    """Of each key of a group the row with the largest ``order``, how many rows it had, and how many came after a later one of an earlier batch."""

    def __init__(self, key: list[str], order: list[str], keys: StructType, kept: StructType):
        self.key, self.order, self.keys, self.kept = key, order, keys, kept
        self.names = kept.names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("latest", self.keys, self.kept)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        own = [n for n in self.names if n not in ("n_rows", "n_late")]
        at = [own.index(c) for c in self.order]
        plain = lambda row: tuple(getattr(v, "item", lambda v=v: v)() for v in row)
        before: dict[tuple, tuple | None] = {}
        found: dict[tuple, list] = {}  # of this batch: best row, rows, late rows
        for part in rows:
            if not len(part):
                continue
            code = part.groupby(self.key, sort=False).ngroup().to_numpy()
            names = [plain(k) for k in part.drop_duplicates(self.key)[self.key].itertuples(index=False, name=None)]
            for k in names:
                if k not in before:
                    before[k] = self.state.getValue(k)
            held = [before[k] for k in names]
            late, same = np.zeros(len(part), bool), np.array([h is not None for h in held])[code]
            for c, i in zip(self.order, at, strict=True):
                values = part[c].to_numpy()
                known = np.empty(len(held), values.dtype)
                known[:] = [values[0] if h is None else h[i] for h in held]
                late |= same & (values < known[code]).astype(bool)
                same &= (values == known[code]).astype(bool)
            n_rows, n_late = np.bincount(code).tolist(), np.bincount(code, late).astype(np.int64).tolist()
            # of rows alike in order the first
            best = part[own].assign(_code=code).sort_values(["_code", *self.order], ascending=[True, *[False] * len(at)], kind="stable").drop_duplicates("_code")[own]
            for k, row, n, m in zip(names, best.itertuples(index=False, name=None), n_rows, n_late, strict=True):
                so_far = found.setdefault(k, [row, 0, 0])
                if tuple(row[i] for i in at) > tuple(so_far[0][i] for i in at):
                    so_far[0] = row
                so_far[1] += n
                so_far[2] += m
        out = []
        for k, (row, n, m) in found.items():
            held = before[k]
            if held is not None:
                n, m = n + held[-2], m + held[-1]
                if not tuple(row[i] for i in at) > tuple(held[i] for i in at):
                    row = held[: len(own)]
            full = (*plain(row), n, m)
            self.state.updateValue(k, full)
            out.append((*k, *full))
        yield pd.DataFrame(out, columns=[*self.key, *self.names])

    def close(self) -> None:
        pass


def latest_by_state(spark: SparkSession, source: str, schema: StructType, table_path: str, key: list[str], order: list[str], checkpoint: str, max_files: int = 100) -> tuple[StreamingQuery, KeyedTable]:
    """Drain the files of ``source`` that are new; (finished query, table of key, latest values, n_rows, n_late).

    Columns of ``order`` and the other values are numbers or texts without nulls."""
    counts = [StructField("n_rows", LongType()), StructField("n_late", LongType())]
    kept = StructType([*[f for f in schema if f.name not in key], *counts])
    out = StructType([*[schema[k] for k in key], *kept])
    table = KeyedTable(spark, table_path, out, key)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # the only store that keyed state of this kind has
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
        dealt = stream.withColumn("_group", F.pmod(F.xxhash64(*key), F.lit(GROUPS)).cast("int")).groupBy("_group")
        changes = dealt.transformWithStateInPandas(Latest(key, order, StructType([schema[k] for k in key]), kept), out, "Update", "None")

        def fold(batch: DataFrame, epoch: int) -> None:
            writer = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
            table.append(batch, Policy((), order=("n_rows",)), writer, epoch)

        query = changes.writeStream.outputMode("update").foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return query, table
