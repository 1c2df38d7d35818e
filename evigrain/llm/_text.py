"""Vectorised tokenising and hashing of Arrow text columns.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. Words get 64-bit hashes,
mixed block by block of eight bytes, with a bijection at each step: words of one length up to eight bytes
never collide, and no pattern of letters makes longer ones collide more often than by chance. All work is
done with numpy over the column's own buffer; only words of more than ``LONG`` bytes are hashed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
CHUNK_BYTES = 1 << 20
LONG = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two hashes."""
    return mix(a * _U(0xD6E8FEB86659FD93) + (b ^ (b >> _U(32))) * _U(0xC2B2AE3D27D4EB4F) + _U(0x165667B19E3779F9))


class Blocks:
    """Runs of bytes read in blocks of eight, the last one filled up with noughts."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.data, self.starts, self.sizes = data, starts, sizes
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        self.words = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
        self.first = self.words[starts] & _MASK[np.minimum(sizes, 8)]

    def block(self, rows: np.ndarray, k: int) -> np.ndarray:
        """The ``k``-th block of these runs, which are long enough to have one."""
        return self.words[self.starts[rows] + 8 * k] & _MASK[np.minimum(self.sizes[rows] - 8 * k, 8)]

    def hashes(self) -> np.ndarray:
        out = mix(mix(self.sizes.astype(np.uint64) + _U(0x5851F42D4C957F2D)) ^ self.first)
        for i in np.flatnonzero(self.sizes > LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.starts[i] + self.sizes[i]])
        rows, k = np.flatnonzero((self.sizes > 8) & (self.sizes <= LONG)), 1
        while len(rows):
            out[rows] = mix(out[rows] ^ self.block(rows, k))
            k += 1
            rows = rows[self.sizes[rows] > 8 * k]
        return out

    def unlike(self, other: np.ndarray) -> np.ndarray:
        """The runs whose bytes differ from those of the run ``other`` names for each."""
        differ = (self.sizes != self.sizes[other]) | (self.first != self.first[other])
        own = other == np.arange(len(other))
        for i in np.flatnonzero(~differ & ~own & (self.sizes > LONG)).tolist():
            a, b, n = self.starts[i], self.starts[other[i]], self.sizes[i]
            differ[i] = not np.array_equal(self.data[a : a + n], self.data[b : b + n])
        rows, k = np.flatnonzero(~differ & ~own & (self.sizes > 8) & (self.sizes <= LONG)), 1
        while len(rows):
            differ[rows[self.block(rows, k) != self.block(other[rows], k)]] = True
            k += 1
            rows = rows[self.sizes[rows] > 8 * k]
        return np.flatnonzero(differ)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    arr = column.cast(pa.large_binary()).fill_null(b"")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most about ``limit`` bytes (one row at least): first row, last row, bytes, offsets."""
    data, offsets = buffers(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the mask of bytes in words. No word crosses a row."""
    inside = ~_WS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, inside


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and for each row the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends, _ = spans(data, offsets)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    return Blocks(_LOW[data], starts, ends - starts).hashes(), first


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct ``width``-word shingle hashes of each row.

    Fewer words than ``width`` make one shingle of all words; no words make an empty set.
    """
    for first, last, data, offsets in chunks(column):
        words, at = word_hashes(data, offsets)
        acc = words
        for k in range(1, width):
            acc = combine(acc[: max(len(words) - k, 0)], words[k:])
        for r in range(first, last):
            lo, hi = at[r - first], at[r - first + 1]
            if hi - lo >= width:
                yield r, distinct(acc[lo : hi - width + 1])
            elif hi > lo:
                x = words[lo : lo + 1]
                for k in range(lo + 1, hi):
                    x = combine(x, words[k : k + 1])
                yield r, mix(x ^ _U(hi - lo))
            else:
                yield r, np.zeros(0, np.uint64)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values in a sorted array."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    new = np.empty(len(sorted_values), bool)
    new[0] = True
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=new[1:])
    return np.flatnonzero(new)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (a sort: here far faster than numpy's own hashing)."""
    s = np.sort(values)
    return s[runs(s)]


def distinct_inverse(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and for each input value its place among them."""
    order = np.argsort(values)
    s = values[order]
    at = runs(s)
    flag = np.zeros(len(s), np.int64)
    flag[at] = 1
    inverse = np.empty(len(s), np.int64)
    inverse[order] = np.cumsum(flag) - 1
    return s[at], inverse
