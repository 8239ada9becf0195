"""Vectorised word segmentation and hashing for Arrow batches inside tasks.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; all separators are ASCII, so
cutting UTF-8 at bytes cuts it at characters. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_POWER_BITS = 20
_POWERS = np.cumprod(np.full(1 << _POWER_BITS, 0x9E3779B97F4A7C15, U))
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
EVERY_BYTE = _BYTE
_WORDS, _LOWER_WORDS = np.where(SEPARATOR, U(0), _BYTE), np.where(SEPARATOR, U(0), _LOWER)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def seeded(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same on every machine."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=U) * U(2) + U(1)


#: Everything ASCII but letters and digits.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_BARE = np.where(PUNCTUATION, U(0), _BYTE)


def bare(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Words of lower-cased texts without ASCII punctuation, and their hashes."""
    w = split(pc.utf8_lower(pc.fill_null(texts, "")), PUNCTUATION)
    return w, hash_spans(w.data, w.start, w.end - w.start, _BARE)


@dataclass
class Words:
    """Words of some texts: of text i, those in ``first[i]:first[i + 1]``; bytes ``start:end`` of data."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (one more for the end)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def split(texts: pa.Array, separator: np.ndarray = SEPARATOR) -> Words:
    data, bounds = raw(texts)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separator[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[bounds] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | begins[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | begins[1:])) + 1
    return Words(data, bounds, start, end, np.searchsorted(start, bounds))


def hash_spans(data: np.ndarray, start: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of what lies from each start to the next; bytes that ``table`` maps to 0 don't count."""
    if not len(start):
        return np.zeros(0, U)
    data = data[start[0] :]
    at = start - start[0]
    place = np.arange(len(data), dtype=np.int32)
    place -= np.repeat(at.astype(np.int32), np.diff(at, append=len(data)))
    if place.max() >> _POWER_BITS:
        place &= (1 << _POWER_BITS) - 1
    value = table[data]
    value *= _POWERS[place]
    return mix(np.add.reduceat(value, at) + lengths.astype(U) * U(0xD6E8FEB86659FD93))


def hashes(w: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, after lower-casing A-Z if asked."""
    return hash_spans(w.data, w.start, w.end - w.start, _LOWER_WORDS if lower else _WORDS)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive items, by place of the first; len(h) - size + 1 of them."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for i, m in enumerate(seeded(size, 77)):
        out += h[i : i + n] * m
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text (one text at least)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of the given lengths from values laid end to end."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Like ``ragged``, as binary values: the items' little-endian bytes."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * values.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())
