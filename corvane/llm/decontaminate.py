"""Benchmark decontamination: an FM-index for each shard of the training texts.

A task reads its documents in shards of bounded size, builds the index of each shard's words and
searches all test phrases in it at once. The index's alphabet is the phrases' vocabulary; any other
word is a separator, as no phrase can hold it. Occurrences are merged into removal spans. There is
no shuffle; the phrases are broadcast in blocks of bounded size (``PHRASE_BYTES`` of benchmark text, held as flat
arrays of about 60 bytes a word), and with more than one block the spans of a document are merged by its row.

Defined results: a null or empty text has no words, no hits and is not contaminated; benchmark rows
with a null text or without words have no window; benchmark rows with a null item_id are left out,
rows that share an item_id are one item; an empty benchmark hits nothing; documents with an equal or
null doc_id are looked at row by row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import as_row, batch_rows, fields, from_row, hold, materialize
from corvane.llm.fm_index import FMIndex

WINDOW = 13
SHARD_WORDS = 250_000
PHRASE_BYTES = 2 << 20
#: Hit words of a contaminated document, as a share of its words: one in this many.
ONE_IN = 20

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

FOUND = "doc_id bigint, n_words bigint, spans array<struct<start:int,stop:int>>, items array<string>"


def item_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class Phrases:
    """Distinct windows of the benchmark items, as right-aligned rows of word codes from 1.

    ``owners[owner_at[w] : owner_at[w + 1]]`` are the items (places in ``names``) that hold window ``w``."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.codes: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        index = {name: i for i, name in enumerate(self.names)}
        blocks, held_by = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int32)]
        for name, text in items:
            words = item_words(text)
            codes = np.fromiter((self.codes.setdefault(w, len(self.codes) + 1) for w in words), np.int32, len(words))
            if len(codes) >= window:
                rows = np.lib.stride_tricks.sliding_window_view(codes, window)
            elif len(codes):
                rows = np.append(np.zeros(window - len(codes), np.int32), codes)[None, :]
            else:
                continue
            blocks.append(rows)
            held_by.append(np.full(len(rows), index[name], np.int32))
        # a row's bytes as one value: equal windows are neighbours once sorted
        every = np.ascontiguousarray(np.concatenate(blocks))
        same = np.unique(every.view(np.dtype((np.void, every.itemsize * window))).ravel(), return_index=True, return_inverse=True) if len(every) else None
        first, which = (same[1], same[2].ravel()) if same else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.rows = every[first]
        self.lengths = (self.rows > 0).sum(axis=1)
        pairs = np.unique(which * max(1, len(self.names)) + np.concatenate(held_by))
        self.owners = (pairs % max(1, len(self.names))).astype(np.int32)
        self.owner_at = np.searchsorted(pairs, np.arange(len(self.rows) + 1) * max(1, len(self.names)))

    def owned_by(self, window: int) -> list[int]:
        return self.owners[self.owner_at[window] : self.owner_at[window + 1]].tolist()


def _search_shard(phrases: Phrases, docs: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
    """Removal spans (in words) and item names of each document of a shard."""
    get = phrases.codes.get
    sizes = np.array([len(d) for d in docs], np.int64)
    begins = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    names: list[list[str]] = [[] for _ in docs]
    if not total or not len(phrases.rows):
        return spans, names
    codes = np.fromiter((get(w, 0) for d in docs for w in d), np.int32, total)
    # one separator before each document and at the end; a run of separators is one separator
    text = np.insert(codes, begins[sizes > 0], 0)
    word_at = np.insert(np.arange(total), begins[sizes > 0], -1)
    kept = np.append(True, (text[1:] != 0) | (text[:-1] != 0))
    text, word_at = np.append(text[kept], 0), word_at[kept]
    if len(text) < 3:
        return spans, names
    index = FMIndex(text, len(phrases.codes) + 1)
    lo, hi = index.search(phrases.rows, phrases.lengths)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return spans, names
    n = hi[found] - lo[found]
    which = np.repeat(found, n)
    ends = np.cumsum(n)
    rows = np.arange(int(ends[-1])) - np.repeat(ends - n - lo[found], n)
    at = word_at[index.locate(rows)]
    # merge the spans: words covered by any occurrence
    cover = np.zeros(total + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + phrases.lengths[which], -1)
    hit = np.cumsum(cover[:-1]) > 0
    doc_of = np.repeat(np.arange(len(docs)), sizes)
    edge = np.append(True, (hit[1:] != hit[:-1]) | (doc_of[1:] != doc_of[:-1]))
    starts = np.flatnonzero(edge & hit)
    stops = np.append(np.flatnonzero(edge), total)
    stops = stops[np.searchsorted(stops, starts, side="right")]
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        d = int(doc_of[a])
        spans[d].append((a - int(begins[d]), b - int(begins[d])))
    seen = np.unique(np.stack([doc_of[at], which]), axis=1)
    items: dict[int, set[int]] = {}
    for d, w in seen.T.tolist():
        items.setdefault(d, set()).update(phrases.owned_by(w))
    for d, owned in items.items():
        names[d] = [phrases.names[i] for i in sorted(owned)]
    return spans, names


def _find(phrases, shard_words: int, extra: list[str], cut: bool = False):
    """Finds in shards; gives doc_id, the ``extra`` columns and what was found, or (``cut``) the texts without it."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("none", dict)
        held: list[pa.RecordBatch] = []
        docs: list[list[bytes]] = []
        words = 0

        def flush() -> pa.RecordBatch:
            spans, names = _search_shard(phrases.value, docs)
            table = pa.Table.from_batches(held).combine_chunks()
            columns = {c: table.column(c).combine_chunks() for c in ("doc_id", *extra)}
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            if cut:  # one Python worker finds and cuts
                pairs = [[{"start": a, "stop": b} for a, b in s] for s in spans]
                columns["text"] = pa.array(_cut(table.column("text").to_pylist(), pairs), pa.string())
                return pa.RecordBatch.from_pydict(columns)
            columns["n_words"] = pa.array([len(d) for d in docs], pa.int64())
            columns["spans"] = pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], kind)
            columns["items"] = pa.array(names, pa.list_(pa.string()))
            return pa.RecordBatch.from_pydict(columns)

        for part in parts:
            texts, done = part.column("text"), 0
            for i in range(part.num_rows):
                docs.append(item_words(texts[i].as_py()))
                words += len(docs[-1])
                if words >= shard_words:
                    held.append(part.slice(done, i + 1 - done))
                    yield flush()
                    held, docs, words, done = [], [], 0, i + 1
            if done < part.num_rows:
                held.append(part.slice(done))
        if docs:
            yield flush()

    return run


def _blocks(benchmark: DataFrame, phrase_bytes: int) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """Number of blocks of about ``phrase_bytes`` of benchmark text, and the blocks, collected one at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("item_id is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // phrase_bytes))

    def collected() -> Iterator[list[tuple[str, str]]]:
        for k in range(n):
            part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
            yield [(r["item_id"], r["text"]) for r in part.toLocalIterator()]

    return n, collected()


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    phrase_bytes: int = PHRASE_BYTES,
    keep_row: bool = False,
) -> DataFrame:
    """One row a document: doc_id, n_words, merged removal spans (in words), items; with ``keep_row`` also text and ``row``, a
    struct of all its columns."""
    spark = docs.sparkSession
    batch_rows(spark)
    kept = ["text", "row"] if keep_row else []
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *([as_row(docs)] if keep_row else []))
    found_fields = FOUND.removeprefix("doc_id bigint, ")
    schema = fields(*[source.schema[c] for c in ("doc_id", *kept)], found_fields)
    n_blocks, blocks = _blocks(benchmark, phrase_bytes)
    if n_blocks > 1:
        source = materialize(source.withColumn("nth", F.monotonically_increasing_id()), "numbered")
        parts = None
        for items in blocks:
            found = source.mapInArrow(
                _find(spark.sparkContext.broadcast(Phrases(items, window)), shard_words, ["nth"]), FOUND.replace(",", ", nth bigint,", 1)
            ).where("size(spans) > 0")
            found = materialize(found.select("nth", "spans", "items"), "found")
            parts = found if parts is None else parts.unionByName(found)
        # at most one row a block and document
        merged = parts.groupBy("nth").agg(F.flatten(F.collect_list("spans")).alias("more"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        empty = spark.sparkContext.broadcast(Phrases([], window))
        numbered = fields(*[source.schema[c] for c in ("doc_id", "nth", *kept)], found_fields)
        counted = source.mapInArrow(_find(empty, shard_words, ["nth", *kept]), numbered).drop("spans", "items")
        joined = counted.join(merged, "nth", "left")
        spans = F.coalesce(_merge(F.col("more")), F.array().cast("array<struct<start:int,stop:int>>"))
        return joined.withColumn("spans", spans).withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).drop("nth", "more")
    phrases = spark.sparkContext.broadcast(Phrases(next(blocks), window))
    return source.mapInArrow(_find(phrases, shard_words, kept), schema)


def _merge(spans):
    """Union of spans in words, as sorted, disjoint spans."""
    ordered = F.array_sort(spans)
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    def add(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["stop"] >= span["start"]),
                      F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(ordered, empty, add)


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs, benchmark, window)
    hits = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["stop"] - s["start"]))
    found = found.withColumn("n_hit", hits)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.lit(ONE_IN) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def _cut(texts: list[str | None], spans: list[list[dict]]) -> list[str | None]:
    out = []
    for text, cuts in zip(texts, spans, strict=True):
        if not cuts:
            out.append(text)
            continue
        places = [m.span() for m in _WORD.finditer(text)]
        pieces, at = [], 0
        for c in cuts:
            pieces.append(text[at : places[c["start"]][0]])
            at = places[c["stop"] - 1][1]
        out.append("".join([*pieces, text[at:]]))
    return out


def _cut_batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        texts = _cut(part.column("text").to_pylist(), part.column("spans").to_pylist())
        yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with all removal spans cut out of their texts; their other columns stay, whatever their names."""
    n_blocks, blocks = _blocks(benchmark, PHRASE_BYTES)
    if n_blocks == 1:
        spark = docs.sparkSession
        batch_rows(spark)
        phrases = spark.sparkContext.broadcast(Phrases(next(blocks), window))
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), as_row(docs))
        cut = rows.mapInArrow(_find(phrases, SHARD_WORDS, ["row"], cut=True), fields(rows.schema["doc_id"], rows.schema["row"], "text string"))
    else:
        found = find_contamination(docs, benchmark, window, keep_row=True)
        cut = found.mapInArrow(_cut_batches, found.schema)
    return from_row(cut, docs.columns, text=F.col("text"))


__all__ = ["FMIndex", "Phrases", "contamination_report", "find_contamination", "item_words", "remove_contamination"]
