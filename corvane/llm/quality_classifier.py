"""Quality classifier: hashed word n-grams, logistic regression trained by follow-the-regularised-leader.

A word is a run of characters other than ASCII white space; it gives a stem and its closing punctuation.
Features are the hashed stems, punctuations, pairs of neighbouring stems (one feature for a word that
repeats the one before) and of punctuations, each weighted by its share of the document's features. A score is
one sparse dot product; documents are scored whole, where they are read, with no shuffle.

The model is fitted on about ``TRAIN_ROWS`` labelled documents at most, chosen by the hash of doc_id; they are trained
in one task, in an order that follows from doc_id alone, so a fit can be repeated. Of documents that share a doc_id
one is learned from.

Defined results: a null or empty text has the bias alone; labels other than 0 and 1 or without a document
are not learned from; with no labels at all each score is 0.5; a null doc_id is never held out and never
learned from; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import LOWER_ASCII, batch_rows, batches, bounded_rows, held_out, hold
from corvane.llm.words import mix

BITS = 20
TRAIN_ROWS = 8_000
EPOCHS = 3
SCALE = np.float32(20.0)
ALPHA, BETA, L1, L2 = 0.6, 1.0, 0.02, 0.05

_CLOSING = b".,;:!?%&$*#|<>()[]{}\"'-=+/~_^`@\\"
_MAX_CACHED = 500_000


class _Stems(dict):
    """word -> 32-bit hash of its stem, shifted, and 32-bit hash of its closing punctuation (0: none)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _MAX_CACHED:
            self.clear()
        stem = word.rstrip(_CLOSING)
        tail = xxhash.xxh32_intdigest(word[len(stem) :]) | 1 if len(stem) < len(word) else 0
        loud = stem.isupper() and len(stem) > 1
        value = self[word] = (xxhash.xxh32_intdigest(stem.translate(LOWER_ASCII), seed=int(loud)) << 32) | tail
        return value


_STEMS = _Stems()


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Hashed feature numbers, one for each occurrence."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if not words:
        return np.empty(0, np.uint32)
    both = np.fromiter(map(_STEMS.__getitem__, words), np.uint64, len(words))
    stems, tails = both >> np.uint64(32), both & np.uint64(2**32 - 1)
    pairs = mix(stems[:-1] * np.uint64(0x9E3779B97F4A7C15) + stems[1:])
    pairs[stems[:-1] == stems[1:]] = np.uint64(1)
    punctuation = mix(tails[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + tails[1:] + np.uint64(3))
    closing = mix(tails + np.uint64(17))
    found = np.concatenate([mix(stems + np.uint64(5)), closing, pairs, punctuation])
    return (found >> np.uint64(64 - bits)).astype(np.uint32)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, then the bias, by FTRL-proximal updates; rows are (features, shares, label)."""
    size = (1 << bits) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for idx, share, label in rows:
            at = np.append(idx.astype(np.int64), size - 1)
            x = np.append(share.astype(np.float64) * SCALE, 1.0)
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            w[at] = wi
            g = (1 / (1 + np.exp(-np.clip(wi @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] = zi + g - sigma * wi
            n[at] = ni + g * g
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)).astype(np.float32)


def _featurize(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches(parts):
        idx, share = [], []
        for text in part.column("text").to_pylist():
            found, counts = np.unique(features(text), return_counts=True)
            idx.append(found.astype("<u4").tobytes())
            share.append((counts / max(1, counts.sum())).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("label").cast(pa.int32()), pa.array(idx, pa.binary()), pa.array(share, pa.binary())],
            names=["doc_id", "label", "idx", "share"],
        )


def _fit_task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = [p for p in parts if len(p)]
    if held:
        frame = pd.concat(held).sort_values(["doc_id", "label"])
        order = np.random.default_rng(5).permutation(len(frame))
        frame = frame.iloc[order]
        rows = [(np.frombuffer(i, "<u4"), np.frombuffer(s, "<f4"), y) for i, s, y in zip(frame["idx"], frame["share"], frame["label"], strict=True)]
        yield pd.DataFrame({"weights": [fit(rows).tobytes()]})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from labelled rows whose doc_id is not held out (crc32 mod 5 is 0)."""
    batch_rows(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("bigint").alias("l_id"), F.col(label).cast("int").alias("label"))
    known = known.where("l_id is not null and label in (0, 1)").where(~held_out(F.col("l_id"), 5, 0))
    sample = bounded_rows(known, "l_id", [], train_rows)
    known = known.distinct().join(F.broadcast(sample), "l_id", "left_semi")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most about train_rows pairs of two numbers are broadcast, two of an id that has both labels
    rows = texts.join(F.broadcast(known), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "label")
    rows = rows.mapInArrow(_featurize, "doc_id bigint, label int, idx binary, share binary")
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct("idx", "share")).alias("x")).select("doc_id", "label", "x.idx", "x.share")
    found = rows.repartition(1).mapInPandas(_fit_task, "weights binary").collect()
    return np.frombuffer(found[0]["weights"], np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def _score(weights):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("stems", _STEMS.clear)
        w = weights.value
        for part in batches(parts):
            scores = []
            for text in part.column("text").to_pylist():
                idx = features(text)
                total = float(w[-1]) + (float(w[idx].sum(dtype=np.float64)) * float(SCALE) / len(idx) if len(idx) else 0.0)
                scores.append(1 / (1 + np.exp(-min(35.0, max(-35.0, total)))))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score of every document."""
    spark = docs.sparkSession
    batch_rows(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_score(spark.sparkContext.broadcast(weights)), "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
