"""ASCII-lower-cased words as bytes, and their hashes, without a regular expression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from corvane.llm._common import LOWER_ASCII, hold

MAX_WORDS_CACHED = 250_000
#: Longer words are hashed one by one.
LONGEST_HASHED = 32

_P1, _P2, _P3, _P4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


class WordHashes(dict):
    """word -> 64-bit hash, computed once for each word that the worker meets."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS_CACHED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = WordHashes()


def hold_words() -> None:
    """To be called as a task starts."""
    hold("words", _HASHES.clear)


def lower_words(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and \\x09-\\x0D of the text with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _P4
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of the whole text if it has fewer words."""
    words = lower_words(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = word_hashes(words)
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = mix(total * _P1 + hashes[k : k + n] * _P2 + _P3)
    return np.unique(total)


#: Odd numbers that a word's 8-byte parts are multiplied by.
_ODD = np.random.default_rng(20240611).integers(0, 2**63, LONGEST_HASHED // 8 + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashes_of(words: pa.Array, odd: np.ndarray = _ODD) -> np.ndarray:
    """64-bit hashes: of short words by numpy from their 8-byte parts and length, of longer ones by xxHash; other odd numbers give other hashes."""
    words = pa.concat_arrays([words.cast(pa.binary())])
    _, places, data = words.buffers()
    ends = np.frombuffer(places, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    sizes = np.diff(ends)
    raw = np.append(np.frombuffer(data or b"", np.uint8), np.zeros(LONGEST_HASHED, np.uint8))
    out = mix(sizes.astype(np.uint64) * odd[-1] + np.uint64(1))
    for k in range(LONGEST_HASHED // 8):
        at = np.flatnonzero(sizes > 8 * k)
        if not len(at):
            break
        part = raw[ends[at][:, None] + np.arange(8 * k, 8 * k + 8)]
        part[np.arange(8 * k, 8 * k + 8) >= sizes[at][:, None]] = 0
        out[at] = mix(out[at] * odd[k] + part.view(np.uint64).ravel())
    for i in np.flatnonzero(sizes > LONGEST_HASHED).tolist():
        out[i] = xxhash.xxh64_intdigest(words[i].as_py(), seed=int(odd[0]) if odd is not _ODD else 0)
    return out
