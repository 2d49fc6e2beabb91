"""Token ids in ORC files.

A document's ids are one row: ``doc_id, local_start, n_tokens, ids array<int>``. Files hold ascending
ranges of doc_id and are sorted within, so ORC's integer run-length encoding, row indexes, stripe
statistics and Bloom filters on ``doc_id`` all apply: a filter on ids reads the stripes it needs,
and any stripe can be read alone. ``local_start`` counts the ids before the document in its file;
with the files' totals (a scan of two integer columns) it gives the place in the whole corpus.

Defined results: a null or empty text has the end id alone; a null doc_id sorts first; rows with an
equal doc_id are ordered by text and each keeps its own row; an empty table gives no rows; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm._common import batch_rows, materialize, scratch_path
from corvane.llm.tokens import encoder, slices, with_end

#: The encoder's cache in a worker: nothing else here needs memory, and words that come again are not encoded again.
CACHE_BYTES = 128 << 20
FILE_SCHEMA = "doc_id bigint, local_start bigint, n_tokens bigint, ids array<int>"


def _encode_partition(path: str, end_id: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, start = encoder(path, CACHE_BYTES), 0
        for part in parts:
            texts, doc_ids = part.column("text"), part.column("doc_id")
            for lo, hi in slices(texts):
                ids, rows = with_end(*enc.encode(texts.slice(lo, hi - lo)), end_id)
                lists = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(lo, hi - lo), pa.array(start + rows[:-1]), pa.array(np.diff(rows)), lists],
                    names=["doc_id", "local_start", "n_tokens", "ids"],
                )
                start += int(rows[-1])
                pa.default_memory_pool().release_unused()

    return run


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, stripe_bytes: int = 16 << 20, row_stride: int = 1000
) -> str:
    """Encode ``docs`` (doc_id, text) and write ORC files under ``path``, which must not exist yet.

    One shuffle: texts are range-partitioned by doc_id. Each task then streams its range."""
    batch_rows(docs.sparkSession)
    ranged = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    (
        ranged.mapInArrow(_encode_partition(tokenizer, end_id), FILE_SCHEMA)
        .write.option("maxRecordsPerFile", "0")  # a task's file holds all its rows, as local_start counts them
        .option("orc.compress", "LZ4")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files with ``start``: the ids of all documents before this one in the corpus.

    Only one small row a file goes through a single task and into a written table, whose size Spark knows as it plans the join;
    the number of files is the number of write tasks, not the number of documents."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path).withColumn("file", F.col("_metadata.file_path"))
    first = F.min(F.coalesce(F.col("doc_id"), F.lit(-(2**63))))
    files = rows.groupBy("file").agg(first.alias("first_id"), F.sum("n_tokens").alias("total"))
    before = Window.orderBy("first_id", "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    bases = materialize(bases, "bases")
    return (
        rows.join(bases, "file")
        .withColumn("start", F.col("base") + F.col("local_start"))
        .select("doc_id", "start", "n_tokens", "ids")
    )


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of some documents; the filter reaches ORC, where statistics and Bloom filters skip stripes."""
    return spark.read.schema(FILE_SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids))


def _checksums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        lists = part.column("ids")
        offsets = lists.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("start"), part.column("n_tokens"), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def checksums(rows: DataFrame) -> DataFrame:
    """crc32 of each row's ids as little-endian unsigned 32-bit integers, in place of the ids."""
    return rows.mapInArrow(_checksums, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the files (under ``path`` or the scratch folder), read them back, return the digest."""
    spark = docs.sparkSession
    path = write_token_files(docs, path or scratch_path(spark, "token_files"), tokenizer, end_id)
    return checksums(read_token_files(spark, path))
