"""Words of a batch of texts as numbers, cut by Arrow's own kernels after one translation of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

from corvane.llm._common import LOWER_ASCII


def translation(blank: bytes, breaks: bytes = b"") -> bytes:
    """A table for bytes.translate: A-Z to a-z, ``blank`` to a space, ``breaks`` to a line feed."""
    table = bytearray(LOWER_ASCII)
    for b in blank:
        table[b] = 0x20
    for b in breaks:
        table[b] = 0x0A
    return bytes(table)


def _translated(texts: pa.Array, table: bytes) -> pa.Array:
    """Only ASCII bytes change, each into one byte: the texts' places in the buffer stay."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.string()), "")])
    if not len(texts):
        return texts
    _, places, data = texts.buffers()
    data = pa.py_buffer((data.to_pybytes() if data else b"").translate(table))
    return pa.Array.from_buffers(pa.string(), len(texts), [None, places, data], offset=texts.offset)


def _starts(lists: pa.Array) -> np.ndarray:
    at = lists.offsets.to_numpy().astype(np.int64)
    return at - at[0] if len(at) else np.zeros(1, np.int64)


def code(texts: pa.Array, table: bytes, pieces: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the word number of every word in order, where each text's words start and end).

    With ``pieces`` the starts are those of the pieces between line feeds instead. A null text has no words."""
    flat = _translated(texts, table)
    if pieces:
        flat = pc.split_pattern(flat, "\n").flatten()
    lists = pc.split_pattern(flat, " ")
    words = lists.flatten().dictionary_encode()
    codes, known = words.indices.to_numpy(), words.dictionary
    starts = _starts(lists)
    empty = pc.index(known, pa.scalar("")).as_py() if len(known) else -1
    if empty >= 0:
        kept = codes != empty
        starts = np.append(0, np.cumsum(kept))[starts]
        codes = codes[kept]
        codes = codes - (codes > empty)
        known = pa.concat_arrays([known.slice(0, empty), known.slice(empty + 1)])
    return known, codes, starts


def unified(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """(distinct words of all parts, every word's number in them) of (distinct words, numbers) part by part."""
    if not parts:
        return pa.array([], pa.string()), np.zeros(0, np.int32)
    chunks = [pa.DictionaryArray.from_arrays(pa.array(codes.astype(np.int32)), words) for words, codes in parts]
    chunks = pa.chunked_array(chunks).unify_dictionaries().chunks
    return chunks[0].dictionary, np.concatenate([c.indices.to_numpy() for c in chunks])


def joined(words: pa.Array) -> bytes:
    """The words with a line feed after each but the last (they have none inside)."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_buffer().to_pybytes() if len(words) else b""


def parted(data: bytes) -> pa.Array:
    """The words that ``joined`` joined, at least one."""
    text = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int32)), pa.py_buffer(data)])
    return pc.split_pattern(text, "\n").flatten()


def byte_order(words: pa.Array) -> np.ndarray:
    """Places of the words in the order of their bytes."""
    return pc.array_sort_indices(words.cast(pa.binary())).to_numpy().astype(np.int64)


def squeeze(data: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes())


def expand(data: bytes, kind: str | None = None):
    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw if kind is None else np.frombuffer(raw, kind)
