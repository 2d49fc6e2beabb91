"""Cached encoding with public tokenizer files.

A byte-pair tokenizer never merges across a white-space boundary, so a text is cut before each
space that follows a character other than white space; equal chunks are encoded once. Ids are
those that encoding the whole text gives: with the byte-level pattern a space only ever starts a token,
and the word tokenizer drops white space altogether. A text to which the cut does not apply is
encoded whole. Chunks are found and counted by Arrow's own kernels, ids are gathered by numpy.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corvane.llm._common import hold
from corvane.llm.words import LONGEST_HASHED, hashes_of

#: Longer chunks are not kept.
MAX_CACHED_CHARS = 48
#: What the kept chunks and their ids may take in a worker, by the sizes of the objects, unless the operator says otherwise.
MAX_CACHE_BYTES = 64 << 20
#: A chunk's key (hash and check of it), its place and size.
_KEY_BYTES, _ENTRY_BYTES = 8 + 4, 4 + 2
#: Odd numbers of the hash that checks the first one.
_CHECK = np.random.default_rng(20261128).integers(0, 2**63, LONGEST_HASHED // 8 + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Chunks that one call encodes, parted by a special token.
GROUP = 256

_ENCODERS: dict[str, ChunkEncoder] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of the stretches that start at ``starts``, one after another."""
    return ids[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


class Kept:
    """Ids of chunks by 64-bit hashes in order, each with 32 bits of another hash, which must agree too."""

    def __init__(self) -> None:
        self.hashes, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.uint16)
        self.ids, self.used = np.zeros(0, np.uint32), 0

    @property
    def n_bytes(self) -> int:
        return (_KEY_BYTES + _ENTRY_BYTES) * len(self.hashes) + 4 * self.used

    def items(self):
        """(key, ids) of all chunks, as bytes."""
        for h, c, a, n in zip(self.hashes, self.checks, self.starts.tolist(), self.sizes.tolist(), strict=True):
            yield h.tobytes() + c.tobytes(), self.ids[a : a + n].tobytes()

    def find(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The place of each chunk, -1 where it isn't kept."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        near = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where((self.hashes[near] == hashes) & (self.checks[near] == checks), near, -1)

    def add(self, hashes: np.ndarray, checks: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Chunks that aren't kept yet, in the order of their hashes."""
        starts = (np.cumsum(sizes) - sizes + self.used).astype(np.uint32)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(len(ids) + self.used // 8, np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.checks = np.insert(self.hashes, at, hashes), np.insert(self.checks, at, checks)
        self.starts, self.sizes = np.insert(self.starts, at, starts), np.insert(self.sizes, at, sizes.astype(np.uint16))

    def shrink(self) -> None:
        """Chunks that came first are the common ones; the last third goes."""
        left = self.starts < self.used * 2 // 3
        self.hashes, self.checks, self.starts, self.sizes = (x[left] for x in (self.hashes, self.checks, self.starts, self.sizes))
        self.used = int((self.starts + self.sizes).max(initial=0))
        self.ids = self.ids[: self.used].copy()


class ChunkEncoder:
    """encode(texts) -> ids of all texts in one array, and where each text's ids start and end."""

    def __init__(self, path: str, cache_bytes: int | None = None):
        self.cache_bytes = cache_bytes or MAX_CACHE_BYTES
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = _drops_space(path)
        self.bare, self.spaced = Kept(), Kept()
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.marks = [content for _, content in special]
        self.part_id, self.part = max(special) if special else (-1, "")
        # a space is written as U+0120 in a byte-level vocabulary
        names = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(names.values(), default=0) + 1, bool)
        self.starts[[i for name, i in names.items() if name.startswith("\u0120")]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _encode_all(self, chunks: list[str], spaced: bool) -> Iterator[bytes]:
        """Ids of each chunk; many chunks go into one call and are told apart by a token that only ends
        or starts one: the special token, or with spaced chunks any token that starts with a space."""
        for start in range(0, len(chunks), GROUP):
            group = chunks[start : start + GROUP]
            if not self.part or any(m in c for m in self.marks for c in group):
                yield from self._whole([" " + c for c in group] if spaced else group)
                continue
            if spaced:
                raw = self._whole([" " + " ".join(group)])[0]
                at = np.flatnonzero(self.starts[np.frombuffer(raw, "<u4")]).tolist()
                at.append(len(raw) // 4)
                yield from (raw[4 * a : 4 * b] for a, b in zip(at, at[1:], strict=False))
            else:
                raw = self._whole([self.part.join(group)])[0]
                at = [-1, *np.flatnonzero(np.frombuffer(raw, "<u4") == self.part_id).tolist(), len(raw) // 4]
                yield from (raw[4 * a + 4 : 4 * b] for a, b in zip(at, at[1:], strict=False))

    def _ids_of(self, chunks: pa.Array, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, one after another, how many each has); the chunks are distinct."""
        kept, full = self.spaced if spaced else self.bare, self.bare.n_bytes + self.spaced.n_bytes > self.cache_bytes
        if full:
            self.bare.shrink()
            self.spaced.shrink()
        hashes, checks = hashes_of(chunks), hashes_of(chunks, _CHECK).astype(np.uint32)
        order = np.argsort(hashes)
        hashes, checks = hashes[order], checks[order]
        at = kept.find(hashes, checks)
        held, missing = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        names = chunks.take(pa.array(order[missing])).to_pylist()
        found = list(self._encode_all(names, spaced))
        new = np.frombuffer(b"".join(found), "<u4")
        own = np.fromiter(map(len, found), np.int64, len(found)) // 4
        del found
        at = at[held]
        ids = np.concatenate([gathered(kept.ids, kept.starts[at].astype(np.int64), kept.sizes[at].astype(np.int64)), new])
        sizes = np.concatenate([kept.sizes[at].astype(np.int64), own])
        self._keep(kept, hashes[missing], checks[missing], names, new, own)
        place = np.empty(len(chunks), np.int64)
        place[order[held]] = np.arange(len(held))
        place[order[missing]] = len(held) + np.arange(len(missing))
        return gathered(ids, (np.cumsum(sizes) - sizes)[place], sizes[place]), sizes[place]

    def _keep(self, kept: Kept, hashes: np.ndarray, checks: np.ndarray, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """New chunks that aren't long, as far as they fit."""
        short = np.fromiter(map(len, names), np.int64, len(names)) <= MAX_CACHED_CHARS
        cost = np.where(short, _KEY_BYTES + _ENTRY_BYTES + 4 * sizes, 0)
        short &= np.cumsum(cost) <= self.cache_bytes - self.bare.n_bytes - self.spaced.n_bytes
        kept.add(hashes[short], checks[short], ids[np.repeat(short, sizes)], sizes[short])

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one after another, how many each has): each word (without a special token in it) encoded by itself.

        Words go into calls many at a time, parted by the special token; without one, each alone."""
        if not self.part:
            found = self._whole(words)
            return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        groups = [self.part.join(words[lo : lo + GROUP]) + self.part for lo in range(0, len(words), GROUP)]
        ids = np.frombuffer(b"".join(self._whole(groups)), "<u4")
        ends = np.flatnonzero(ids == self.part_id)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _odd(self, texts: pa.StringArray) -> pa.BooleanArray:
        """Texts that are encoded whole."""
        if not self.drops_space:
            return pc.match_substring_regex(texts, r"^ |[\s\x{1C}-\x{1F}\x{85}\x{180E}\pZ] ")
        odd = pa.array(np.zeros(len(texts), bool))
        for m in self.marks:  # the file lower-cases; a special token's own case counts
            odd = pc.or_(odd, pc.match_substring(texts, m, ignore_case=True))
        return odd

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets: text i has ids[offsets[i] : offsets[i + 1]]). Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = self._odd(texts)
        odd_rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        plain = pc.if_else(odd, "", texts) if len(odd_rows) else texts
        if self.drops_space:
            plain = pc.replace_substring(pc.ascii_lower(plain), "\n", " ")
        lists = pc.split_pattern(plain, " ")
        chunks = lists.flatten().dictionary_encode()
        which = chunks.indices.to_numpy().copy()
        words = chunks.dictionary
        firsts = lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets[0].as_py()
        if self.drops_space:
            flat, sizes = self._ids_of(words, False)
        else:
            heads = words.take(pa.array(which[firsts])).dictionary_encode()
            which[firsts] = len(words) + heads.indices.to_numpy()
            used = np.zeros(len(words), bool)
            used[which[which < len(words)]] = True
            flat, sizes = self._ids_of(words.filter(pa.array(used)), True)
            place = np.cumsum(used) - 1
            low = which < len(words)
            which[low] = place[which[low]]
            which[~low] += len(sizes) - len(words)
            more, own = self._ids_of(heads.dictionary, False)
            flat, sizes = np.concatenate([flat, more]), np.concatenate([sizes, own])
        if len(odd_rows):
            # an odd text was cut as the empty text: one chunk, which now stands for the whole
            which[firsts[odd_rows]] = len(sizes) + np.arange(len(odd_rows))
            whole = self._whole([texts[int(i)].as_py() for i in odd_rows])
            flat = np.concatenate([flat, np.frombuffer(b"".join(whole), "<u4")])
            sizes = np.concatenate([sizes, np.fromiter(map(len, whole), np.int64, len(whole)) // 4])
        starts = np.cumsum(sizes) - sizes
        del words, chunks
        # 32-bit places where they suffice: these arrays are as long as the text has chunks or ids
        total = int(sizes @ np.bincount(which, minlength=len(sizes))) if len(which) else 0
        narrow = np.int32 if max(total, len(flat)) < 2**31 else np.int64
        n = sizes.astype(narrow)[which]
        ends = np.cumsum(n, dtype=narrow)
        shift = starts.astype(narrow)[which] - ends
        shift += n
        take = np.repeat(shift, n)
        take += np.arange(total, dtype=narrow)
        ids = flat[take]
        del take, shift
        rows = np.append(narrow(0), ends)[np.append(firsts, len(which))].astype(np.int64)
        return ids, rows


def encoder(path: str, cache_bytes: int | None = None) -> ChunkEncoder:
    """One encoder for each Python worker; workers are reused, and so is the cache."""
    hold("tokens", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    _ENCODERS[path].cache_bytes = cache_bytes or MAX_CACHE_BYTES
    return _ENCODERS[path]


def with_end(ids: np.ndarray, rows: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with ``end_id`` after each."""
    return np.insert(ids, rows[1:], np.uint32(end_id)), rows + np.arange(len(rows))


def _drops_space(path: str) -> bool:
    """Whether the file's pre-tokenizer keeps matches of a pattern alone and so drops white space."""
    with open(path, encoding="utf-8") as f:
        pre = json.load(f).get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [{}])[0] if pre.get("type") == "Sequence" else pre
    if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert"):
        return True
    if first.get("type") == "ByteLevel":
        return False
    raise ValueError(f"{path}: its pre-tokenizer is neither byte-level nor a pattern that drops white space")


def slices(texts: pa.Array, limit_bytes: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of bounded total length (at least one row each)."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit_bytes:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)
