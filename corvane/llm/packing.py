"""Best-fit packing of token sequences by hierarchical residual packing.

Round 0 runs where the documents are read: each task encodes its documents, cuts only those longer
than a sequence, and packs the pieces best-fit, longest first, in groups of bounded size. Bins that
are nearly full are final. The underfull ones become items: they are dealt out anew to fewer tasks
and packed again, round after round, until one task holds them all or a round saves next to
nothing. Each round's result is a small table child bin -> parent bin, offset; a piece's
place is the sum of the offsets along its way up. No task ever holds more than ``group_items`` items
at once, and the rounds see bins, never pieces or ids.

Defined results: a null or empty text is the end id alone; rows with an equal or null doc_id are packed
each for itself; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import batch_rows, batches, materialize
from corvane.llm.tokens import encoder, slices, with_end

#: Pieces or bins that a task packs at once.
GROUP_ITEMS = 60_000
#: Text encoded at once, and the encoder's cache in a worker. With ids, which are held until their group is packed, both are
#: smaller, and so many times fewer items are held.
SLICE_BYTES, CACHE_BYTES = 8 << 20, 128 << 20
SLICE_WITH_IDS, CACHE_WITH_IDS, ITEMS_WITH_IDS = 2 << 20, 24 << 20, 32
#: A bin with at most this share of its capacity free is final.
NEARLY_FULL = 1 / 512
#: Another round must save at least this share of the bins.
LEAST_SAVED = 0.001

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, offset bigint, fill bigint"
BINS = "bin bigint, parent bigint, shift bigint, fill bigint"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the offset of each item, and the fill of each bin.

    Open bins are kept by their free space; an integer used as a bit set finds the tightest."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_bits, fills = 0, []
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = open_bits >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                open_bits ^= 1 << free
        else:
            free, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if free > n:
            if not by_free[free - n]:
                open_bits |= 1 << (free - n)
            by_free[free - n].append(b)
    return bins, offsets, np.array(fills, np.int64)


def _bin_base(level: int) -> int:
    """First bin number of this task: tasks of one round never share numbers, nor do rounds."""
    return (level << 56) | (TaskContext.get().partitionId() << 32)


def _lists(arrays: Sequence[np.ndarray]) -> pa.ListArray:
    offsets = np.append(0, np.cumsum([len(a) for a in arrays])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))


def _pack_documents(tokenizer: str, end_id: int, capacity: int, group_items: int, with_ids: bool):
    def packed(rows: list[tuple], base: int, used: int) -> tuple[pa.RecordBatch, int]:
        doc, piece, start, length, crc, *ids = zip(*rows, strict=True)
        bins, offsets, fills = best_fit(np.array(length, np.int64), capacity)
        columns = {
            "doc_id": pa.array(doc, pa.int64()),
            "piece": pa.array(piece, pa.int32()),
            "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()),
            **({"ids": _lists(ids[0])} if with_ids else {}),
            "bin": pa.array(base + used + bins),
            "offset": pa.array(offsets),
            "fill": pa.array(fills[bins]),
        }
        return pa.RecordBatch.from_pydict(columns), used + len(fills)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, CACHE_WITH_IDS if with_ids else CACHE_BYTES)
        rows: list[tuple] = []
        base, used = _bin_base(0), 0
        for part in batches(parts):
            texts, doc_ids = part.column("text"), part.column("doc_id").to_pylist()
            for lo, hi in slices(texts, SLICE_WITH_IDS if with_ids else SLICE_BYTES):
                ids, ends = with_end(*enc.encode(texts.slice(lo, hi - lo)), end_id)
                raw, at = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), ends.tolist()
                for doc, first, last in zip(doc_ids[lo:hi], at, at[1:], strict=False):
                    for k, a in enumerate(range(first, last, capacity)):
                        b = min(a + capacity, last)
                        row = (doc, k, a - first, b - a, zlib.crc32(raw[4 * a : 4 * b]))
                        rows.append((*row, ids[a:b].view("<i4")) if with_ids else row)
                del raw, ids, ends
                if len(rows) >= (max(1, group_items // ITEMS_WITH_IDS) if with_ids else group_items):
                    batch, used = packed(rows, base, used)
                    yield batch
                    rows = []
        if rows:
            yield packed(rows, base, used)[0]

    return run


def _pack_bins(level: int, capacity: int, group_items: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, used, held = _bin_base(level), 0, []
        size = 0

        def flush() -> pd.DataFrame:
            nonlocal used, held, size
            frame = pd.concat(held, ignore_index=True)
            bins, offsets, fills = best_fit(frame["fill"].to_numpy(np.int64), capacity)
            out = pd.DataFrame({"bin": frame["bin"], "parent": base + used + bins, "shift": offsets, "fill": fills[bins]})
            used, held, size = used + len(fills), [], 0
            return out

        for part in parts:
            if len(part):
                held.append(part)
                size += len(part)
            if size >= group_items:
                yield flush()
        if held:
            yield flush()

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    capacity: int = 4096,
    group_items: int = GROUP_ITEMS,
    with_ids: bool = False,
) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    batch_rows(spark)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = PIECES if not with_ids else PIECES.replace("bin bigint", "ids array<int>, bin bigint")
    run = _pack_documents(tokenizer, end_id, capacity, group_items, with_ids)
    pieces = materialize(source.mapInArrow(run, schema), "pieces")

    underfull = F.col("fill") < capacity - math.ceil(capacity * NEARLY_FULL)
    items = pieces.where((F.col("offset") == 0) & underfull).select("bin", "fill")
    n_items, level, ways = items.count(), 0, None
    while n_items > 1:
        level += 1
        tasks = max(1, math.ceil(n_items / group_items))
        dealt = items.repartition(tasks, F.xxhash64("bin", F.lit(level))) if tasks > 1 else items.coalesce(1)
        merged = materialize(dealt.mapInPandas(_pack_bins(level, capacity, group_items), BINS), f"merge_{level}")
        step = merged.select("bin", "parent", "shift")
        if ways is None:
            ways = step
        else:
            up = step.select(F.col("bin").alias("parent"), F.col("parent").alias("next"), F.col("shift").alias("more"))
            ways = ways.join(up, "parent", "left").select(
                "bin",
                F.coalesce("next", "parent").alias("parent"),
                (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"),
            )
        firsts = merged.where(F.col("shift") == 0)
        n_bins = firsts.count()
        items = firsts.where(underfull).select(F.col("parent").alias("bin"), "fill")
        saved, n_items = n_items - n_bins, items.count()
        if tasks == 1 or saved < LEAST_SAVED * n_bins:
            break
    if ways is not None:
        pieces = pieces.join(ways, "bin", "left")
    else:
        pieces = pieces.withColumns({"parent": F.lit(None).cast("bigint"), "shift": F.lit(None).cast("bigint")})
    return pieces.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("parent", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        *(["ids"] if with_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences of ``pack(..., with_ids=True)``: sequence_id, doc_ids, ids. A group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.flatten("parts.ids").alias("ids")
    )
