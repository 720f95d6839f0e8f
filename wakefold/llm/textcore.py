"""Vectorised helpers over the bytes of Arrow text columns, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, U64), _INVERSE: np.ones(1, U64)}

SPACES = bytes([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: Letters and digits of ASCII and every byte of a longer character; all else parts tokens.
IS_PUNCTUATION = np.ones(256, bool)
IS_PUNCTUATION[128:] = False
for _first, _last in ((48, 57), (65, 90), (97, 122)):
    IS_PUNCTUATION[_first : _last + 1] = False


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of the base modulo 2**64; grown on demand and kept."""
    have = _powers[base]
    while len(have) < n:
        step = np.array(pow(base, len(have), 1 << 64), U64)
        have = np.concatenate([have, have * step])
    _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, one to one."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of (byte + 1) * base**position over i..j-1."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(_BASE, len(data)), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges that do not depend on where the range lies."""
    return mix((prefix[end] - prefix[begin]) * powers(_INVERSE, len(prefix))[begin])


class Slice:
    """Some consecutive texts of a batch as one byte array with bounds."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int):
        self.data, self.starts, self.ends, self.first = data, starts, ends, first

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[Slice]:
    """Cuts a text column (null: empty) into runs of whole texts of about ``most`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        base = offsets[at]
        yield Slice(data[base : offsets[upto]], offsets[at:upto] - base, offsets[at + 1 : upto + 1] - base, at)
        at = upto


class Words:
    """Words of a slice: byte bounds, the text each belongs to, a 64-bit hash."""

    def __init__(self, piece: Slice, separators: np.ndarray = IS_SPACE, lower: bool = True):
        data = LOWER[piece.data] if lower else piece.data
        inside = ~separators[data]
        first = np.zeros(len(data) + 1, bool)
        first[piece.starts] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:-1]
        ends[:-1] &= ~inside[1:] | first[1:-1]
        self.begin = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(piece.starts, self.begin, "right") - 1
        self.hash = range_hashes(prefix_hashes(data), self.begin, self.end)
        #: bounds[i], bounds[i + 1]: the words of text i
        self.bounds = np.searchsorted(self.doc, np.arange(len(piece) + 1))

    def __len__(self) -> int:
        return len(self.begin)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; the caller leaves out runs across texts."""
    if len(words) < n:
        return np.zeros(0, U64)
    total = np.zeros(len(words) - n + 1, U64)
    for k in range(n):
        total = total * U64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k]
    return mix(total)


def shingle_sets(piece: Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingle hashes of each text, one after the other, and their bounds.

    A text of fewer words gives its whole sequence as one shingle, a text without words nothing.
    """
    words = Words(piece)
    grams = gram_hashes(words.hash, n)
    parts, bounds = [], np.zeros(len(piece) + 1, np.int64)
    for i in range(len(piece)):
        a, b = words.bounds[i], words.bounds[i + 1]
        if b - a >= n:
            part = np.unique(grams[a : b - n + 1])
        elif b > a:
            part = gram_hashes(words.hash[a:b], int(b - a)) ^ U64(b - a)
        else:
            part = grams[:0]
        parts.append(part)
        bounds[i + 1] = bounds[i] + len(part)
    return (np.concatenate(parts) if parts else grams[:0]), bounds


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Rows by their first column, from batches in which equal keys are neighbours."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, group in groupby(rows, key=itemgetter(0)):
        yield key, list(group)
