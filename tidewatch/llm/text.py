"""Vectorised word and shingle hashing over Arrow string columns.

Everything works on flat byte buffers: a whole batch of texts is lower-cased,
split and hashed with a handful of numpy passes, whole texts always.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(BLANKS)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ROLL = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of a hash can be used alone."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and inverse powers up to n; the longest so far are kept."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in one array and each text's offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes; a longer text is a range alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


class Words:
    """The words of some texts: byte ranges, hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        n = len(data)
        self.data = _LOWER[data] if lower else data
        blank = _BLANK[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        first = ~blank
        first[1:] &= blank[:-1] | edge[1:n]
        last = ~blank
        last[:-1] &= blank[1:] | edge[1:n]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.start, offsets)
        self.hash = span_hash(self.data, self.start, self.end)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from running sums over the buffer; starts ascend."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):  # a block of ranges at a time, so that long buffers need no long tables
        j = max(i + 1, int(np.searchsorted(start, start[i] + CHUNK_BYTES)))
        base, top = int(start[i]), int(end[i:j].max())
        up, down = powers(top - base)
        total = np.zeros(top - base + 1, dtype=np.uint64)
        np.cumsum((data[base:top].astype(np.uint64) + np.uint64(1)) * up[: top - base], out=total[1:])
        out[i:j] = mix((total[end[i:j] - base] - total[start[i:j] - base]) * down[start[i:j] - base])
        i = j
    return out


def batches(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for each chunk of a column of texts."""
    data, offsets = flat(column)
    for i, j in chunks(offsets):
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of width words, or of the whole where there are fewer (none: no hash)."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(width, n)
    total = np.full(n - k + 1, np.uint64(k), dtype=np.uint64)
    for j in range(k):
        total += words[j : n - k + 1 + j] * _ROLL[j % 5] + np.uint64(j)
    return mix(total)


def shingle_sets(words: Words, width: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    n = len(words.hash)
    if n >= width:
        rolled = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
        for j in range(width):
            rolled += words.hash[j : n - width + 1 + j] * _ROLL[j % 5] + np.uint64(j)
        rolled = mix(rolled)
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if b - a >= width:
            run = np.sort(rolled[a : b - width + 1])
            keep = np.ones(len(run), dtype=bool)
            np.not_equal(run[1:], run[:-1], out=keep[1:])
            yield run[keep]
        else:
            yield shingles(words.hash[a:b], width)


def line_keys(text: str) -> list[bytes]:
    """The key of each line: blanks stripped at both ends, A-Z lower-cased, as UTF-8."""
    return [x.strip(BLANKS).lower() for x in text.encode("utf-8", "surrogatepass").split(b"\n")]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()
