"""Shared pieces of the corpus operators: splits, bounded samples, worker caches, columns put away."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corvane.scratch import delete, materialize, scratch_path, scratch_root, scratch_scope

__all__ = [
    "LOWER_ASCII", "as_row", "batch_rows", "batches", "bounded_rows", "delete", "fields", "from_row", "give_back", "held_out", "hold", "materialize",
    "remainder", "scratch_path", "scratch_root", "scratch_scope", "table",
]

#: ASCII A-Z to a-z; every other byte stays.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Arrow batches of all operators here: whole texts may be long, and a batch is held in the Python worker.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct named ``row``, so that no helper column can clash with one of them."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row")


def fields(*parts: str | StructField) -> StructType:
    """A schema of DDL texts and fields, in order."""
    out = StructType()
    for part in parts:
        for field in StructType.fromDDL(part).fields if isinstance(part, str) else [part]:
            out = out.add(field)
    return out


def from_row(rows: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns that ``as_row`` put away, with some of them changed."""
    return rows.select(*[changed.get(c.lower(), F.col("row").getField(c)).alias(c) for c in names])


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def held_out(doc_id: Column, modulus: int, value: int) -> Column:
    return F.coalesce(remainder(doc_id, modulus) == F.lit(value), F.lit(False))


_HELD: dict[str, Callable[[], object]] = {}


def hold(name: str, clear: Callable[[], object]) -> None:
    """Called as a task starts to use a cache that outlives it in its Python worker: the other operators'
    caches in the worker are emptied and freed memory is given back, so a worker that serves one stage after another holds one of them."""
    others = [x for x in _HELD if x != name]
    for other in others:
        _HELD.pop(other)()
    if others:
        gc.collect()
        give_back()
    _HELD[name] = clear


def give_back() -> None:
    """Freed memory goes back to the system, as far as the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; a batch's memory goes back to the system once it is done."""
    for part in parts:
        yield part
        del part
        pa.default_memory_pool().release_unused()


def batch_rows(spark: SparkSession) -> None:
    """The session's Arrow batches get a size that suits whole texts; the same for every operator here, as frames run after
    they are made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def bounded_rows(rows: DataFrame, key: str, strata: list[str], bound: int, salt: int = 0) -> DataFrame:
    """A deterministic sample of at most about ``bound`` of the rows of each stratum, chosen by the hash of ``key``; of rows
    that are alike in key and stratum, one.

    ``rows`` are slim (key and strata alone go on). There may be any number of strata: their counts are joined, not listed.
    The sample is a written table, so Spark knows its size when it plans a join with it."""
    slim = rows.select(key, *strata).distinct()
    unit = (F.xxhash64(F.col(key), F.lit(salt)).cast("double") / F.lit(float(2**64))) + F.lit(0.5)
    if strata:
        counts = slim.groupBy(*[F.col(s).alias(f"s{i}") for i, s in enumerate(strata)]).agg(F.count(F.lit(1)).alias("n_rows"))
        same = F.lit(True)
        for i, s in enumerate(strata):
            same = same & F.col(s).eqNullSafe(F.col(f"s{i}"))
        slim = slim.join(counts, same)
    else:
        slim = slim.withColumn("n_rows", slim.agg(F.count(F.lit(1))).scalar())
    return materialize(slim.where(unit < F.lit(float(bound)) / F.col("n_rows")).select(key, *strata), "sample")
