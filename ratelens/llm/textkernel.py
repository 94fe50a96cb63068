"""Byte-level text kernel: words, word hashes and word-window hashes of a whole Arrow batch in numpy.

Every function works on one chunk of documents at a time (a few MB), never on a whole partition, so the
memory of a task does not follow the number or the length of documents, apart from the one longest text.

Words are runs of bytes that are not separators. The two word definitions of this package depend on ASCII
bytes alone, and every byte of a non-ASCII character is >= 0x80, so splitting UTF-8 bytes and splitting
characters give the same words. Hashes are 64-bit: two different words or windows of one comparison share
a value with a probability around 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are [^\x20\x09-\x0D]+
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, which after lower-casing are digits, a-z and every byte from 0x80.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = np.uint64(0xD1342543DE82EF95)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a chunk in order; those of document i are start[ptr[i]:ptr[i+1]]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def hashes(self) -> np.ndarray:
        up, down = _powers(len(self.data) + 1)
        total = np.empty(len(self.data) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within the bytes) of slices of about `limit` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Words:
    low = LOWER[data]
    inside = ~separators[low]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets))
    heads, tails = offsets[full], offsets[full + 1] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    start = np.flatnonzero(first)
    return Words(low, start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (n - k + 1 values); windows of other lengths differ."""
    if len(hashes) < k:
        return np.zeros(0, dtype=np.uint64)
    n = len(hashes) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out *= _STEP
        out += hashes[j : j + n]
    return mix(out)


def shingle_sets(w: Words, k: int) -> Iterator[np.ndarray]:
    """For each document its sorted distinct k-word shingles; with fewer words, the whole sequence as one."""
    hashes = w.hashes()
    rolled = windows(hashes, k)
    for a, b in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist()):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        else:
            yield windows(hashes[a:b], b - a) if b > a else np.zeros(0, dtype=np.uint64)



def windows_at(hashes: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """The values of windows(hashes, k) at some positions."""
    out = np.full(len(start), k, dtype=np.uint64)
    for j in range(k):
        out *= _STEP
        out += hashes[start + j]
    return mix(out)
