"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1 that follows from its code point. An n-gram's vector binds
(multiplies) its letters' vectors, each permuted (rotated) by its place; a document's vector bundles (adds)
those of all its n-grams, and a language's prototype bundles the normalised vectors of its documents. A
document has the language whose prototype is nearest by cosine.

A document's vector is a row of n-gram counts times the matrix of n-gram vectors, so a batch of
documents is one matrix product; the n-gram vectors are made once in each worker.

Prototypes are learned from at most ``TRAIN_ROWS`` documents of each language, chosen by the hash of doc_id; every
language is learned, however many there are. Prototypes are a written table of 4 KB a language, of which blocks of
``LANG_BLOCK`` languages come to the driver and the workers, one after another.

Defined results: null text or no letter gives ``und`` with score 0, and so does a corpus with no language to
learn; equal cosines go to the language that sorts first; a null doc_id is never held out and never learned
from; texts are read whole; columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import as_row, batch_rows, batches, bounded_rows, fields, from_row, held_out, hold, materialize

DIMENSIONS = 1024
NGRAM = 3
TRAIN_ROWS = 3_000
UNKNOWN = "und"
LANG_BLOCK = 2048

BATCH_DOCS, BATCH_CHARS = 64, 400_000
_FAST_SLOTS = 160
_MAX_VECTORS = 60_000


class Encoder:
    """n-gram counts of texts and the vectors of the n-grams, kept by the worker."""

    def __init__(self) -> None:
        self.slots = np.full(0x110000, -1, np.int32)
        self.letters: list[np.ndarray] = [self._vector(0)]
        self._reset()

    def _reset(self) -> None:
        self.row_of: dict[int, int] = {}
        self.fast = np.full(_FAST_SLOTS**NGRAM, -1, np.int32)
        self.vectors = np.empty((1024, DIMENSIONS), np.int8)

    @staticmethod
    def _vector(code_point: int) -> np.ndarray:
        return (np.random.default_rng([71, code_point]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.int8)

    def _learn_letters(self, points: np.ndarray) -> None:
        for p in np.unique(points[self.slots[points] < 0]).tolist():
            if chr(p).isalpha():
                self.slots[p] = len(self.letters)
                self.letters.append(self._vector(p))
            else:
                self.slots[p] = 0

    def _rows(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Row of each n-gram's vector; new ones are made. Slot 0 is a word boundary."""
        if len(self.row_of) > _MAX_VECTORS:
            self._reset()
        small = len(self.letters) <= _FAST_SLOTS
        if small:
            code = (a * _FAST_SLOTS + b) * _FAST_SLOTS + c
            rows = self.fast[code]
            new = np.unique(code[rows < 0])
            names = zip(new.tolist(), (new // _FAST_SLOTS**2).tolist(), (new // _FAST_SLOTS % _FAST_SLOTS).tolist(), (new % _FAST_SLOTS).tolist(), strict=True)
        else:
            code = (a.astype(np.int64) << 42) | (b.astype(np.int64) << 21) | c
            seen, inverse = np.unique(code, return_inverse=True)
            names = ((-1, int(x) >> 42, (int(x) >> 21) & 0x1FFFFF, int(x) & 0x1FFFFF) for x in seen)
        at = []
        for fast, x, y, z in names:
            key = (x << 42) | (y << 21) | z
            row = self.row_of.get(key)
            if row is None:
                row = self.row_of[key] = len(self.row_of)
                if row == len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
                self.vectors[row] = np.roll(self.letters[x], 2) * np.roll(self.letters[y], 1) * self.letters[z]
            if fast >= 0:
                self.fast[fast] = row
            at.append(row)
        return self.fast[code] if small else np.array(at, np.int64)[inverse]

    def bundle(self, texts: list[str]) -> np.ndarray:
        """One row a text: the sum of its n-grams' vectors; zeros without letters."""
        lowered = [t.lower() for t in texts]
        sizes = np.array([len(t) + 1 for t in lowered])
        points = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        self._learn_letters(points)
        s = self.slots[points]
        doc = np.concatenate([[0], np.repeat(np.arange(len(texts)), sizes)])
        kept = np.append(True, (s[1:] != 0) | (s[:-1] != 0))
        s, doc = s[kept], doc[kept]
        middle = np.flatnonzero(s[1:-1] != 0) + 1
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        if not len(middle):
            return out
        rows = self._rows(s[middle - 1], s[middle], s[middle + 1])
        used, local = np.unique(rows, return_inverse=True) if len(self.row_of) > 4 * len(rows) else self._local(rows)
        counts = np.bincount(doc[middle] * len(used) + local, minlength=len(texts) * len(used)).reshape(len(texts), len(used))
        for lo in range(0, len(used), 4096):
            out += counts[:, lo : lo + 4096].astype(np.float32) @ self.vectors[used[lo : lo + 4096]].astype(np.float32)
        return out

    def _local(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        present = np.zeros(len(self.row_of), bool)
        present[rows] = True
        return np.flatnonzero(present), (np.cumsum(present) - 1)[rows]


_ENCODER: list[Encoder] = []


def encoder() -> Encoder:
    hold("letters", _ENCODER.clear)
    if not _ENCODER:
        _ENCODER.append(Encoder())
    return _ENCODER[0]


def _batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and (total + n > BATCH_CHARS or i - start >= BATCH_DOCS):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def _sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the normalised vectors of each language in this task; those of LANG_BLOCK languages are held at most."""
    enc, sums = encoder(), {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang in sorted(sums):
            # whole numbers add up alike in any order
            whole = np.round(sums[lang] * 2**32).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(whole)], names=["lang", "dim", "value"]
            )
        sums.clear()

    for part in batches(parts):
        texts, langs = part.column("text").to_pylist(), part.column("lang").to_pylist()
        for lo, hi in _batches(texts):
            vectors = enc.bundle([t or "" for t in texts[lo:hi]])
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors = vectors / np.where(norms > 0, norms, 1)
            for lang, v in zip(langs[lo:hi], vectors, strict=True):
                sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
            if len(sums) >= LANG_BLOCK:
                yield from flush()
    yield from flush()


def _unit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each language's sums as a unit vector."""
    for part in batches(parts):
        langs, vectors = [], []
        for lang, places, values in zip(*[part.column(c).to_pylist() for c in ("lang", "dims", "vals")], strict=True):
            v = np.zeros(DIMENSIONS)
            v[places] = values
            if (norm := np.linalg.norm(v)) > 0:
                langs.append(lang)
                vectors.append((v / norm).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(vectors, pa.binary())], names=["lang", "vector"])


@dataclass(frozen=True)
class Prototypes:
    """Unit prototypes as a written table (lang, vector, block); a block of at most about LANG_BLOCK languages is
    collected at a time."""

    rows: DataFrame
    n_langs: int
    n_blocks: int

    def blocks(self) -> Iterator[tuple[list[str], np.ndarray]]:
        for k in range(self.n_blocks):
            found = sorted((r["lang"], bytes(r["vector"])) for r in self.rows.where(F.col("block") == k).toLocalIterator())
            matrix = np.frombuffer(b"".join(v for _, v in found), "<f4").reshape(len(found), DIMENSIONS)
            yield [lang for lang, _ in found], matrix


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, lang_block: int = LANG_BLOCK) -> Prototypes:
    """Prototypes from documents with a language that are not held out (crc32 mod 4 is 2)."""
    batch_rows(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id"), 4, 2))
    sample = bounded_rows(known, "doc_id", ["lang"], train_rows, salt=5)
    known = known.join(sample, ["doc_id", "lang"], "left_semi").select("text", "lang")
    sums = known.mapInArrow(_sums, "lang string, dim int, value bigint").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    pairs = F.collect_list(F.struct("dim", "value")).alias("pairs")  # DIMENSIONS pairs a language
    lists = sums.groupBy("lang").agg(pairs).select("lang", F.col("pairs.dim").alias("dims"), F.col("pairs.value").alias("vals"))
    units = materialize(lists.mapInArrow(_unit, "lang string, vector binary"), "prototypes")
    n = units.count()
    n_blocks = max(1, -(-n // lang_block))
    return Prototypes(units.withColumn("block", F.pmod(F.xxhash64("lang"), F.lit(n_blocks))), n, n_blocks)


def _predict(block, carried: list[str], again: bool):
    """The nearest of the block's languages, or (``again``) what was found before if that is nearer."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prototypes = block.value
        enc = encoder()
        for part in batches(parts):
            texts = part.column("text").to_pylist()
            names: list[str] = []
            scores: list[float] = []
            for lo, hi in _batches(texts):
                vectors = enc.bundle([t or "" for t in texts[lo:hi]])
                norms = np.linalg.norm(vectors, axis=1)
                if not langs:
                    norms[:] = 0
                cosines = vectors @ prototypes.T / np.where(norms > 0, norms, 1)[:, None] if langs else np.zeros((hi - lo, 1))
                best = cosines.argmax(axis=1)
                for i, n in enumerate(norms.tolist()):
                    names.append(langs[best[i]] if n > 0 else UNKNOWN)
                    scores.append(float(cosines[i, best[i]]) if n > 0 else 0.0)
            if again:
                before = zip(part.column("lang_pred").to_pylist(), part.column("lang_score").to_pylist(), strict=True)
                both = zip(before, zip(names, scores, strict=True), strict=True)
                nearer = [min((x for x in pair if x[0] != UNKNOWN), key=lambda x: (-x[1], x[0]), default=(UNKNOWN, 0.0)) for pair in both]
                names, scores = [x[0] for x in nearer], [x[1] for x in nearer]
            columns = [part.column(c) for c in carried] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, "lang_pred", "lang_score"])

    return run


def nearest(rows: DataFrame, kept: list[str], model: Prototypes) -> DataFrame:
    """The ``kept`` columns of rows (text, ...) with lang_pred and lang_score.

    One pass without a shuffle; with more than one block of languages a written pass a block."""
    spark = rows.sparkSession
    batch_rows(spark)
    for k, block in enumerate(model.blocks()):
        last = k == model.n_blocks - 1
        carried = kept if last else [*kept, "text"]
        schema = fields(*[rows.schema[c] for c in carried], "lang_pred string, lang_score double")
        rows = rows.mapInArrow(_predict(spark.sparkContext.broadcast(block), carried, k > 0), schema)
        rows = rows if last else materialize(rows, "nearest")
    return rows.withColumn("lang_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "lang_score")))


def predict(docs: DataFrame, model: Prototypes) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``, so none can clash), lang_pred and lang_score."""
    return nearest(docs.select(F.col("text").cast("string").alias("text"), as_row(docs)), ["row"], model)


def keep_languages(docs: DataFrame, min_score: float) -> DataFrame:
    """The documents with a letter whose nearest language is at least ``min_score`` near. Where no language can be learned, that
    says nothing of a document, and all with a letter stay."""
    model = train(docs)
    if not model.n_langs:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    found = predict(docs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= min_score))
    return from_row(found, docs.columns)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = nearest(texts, ["doc_id"], train(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
