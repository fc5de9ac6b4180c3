"""Vectorised byte-level text kernels for Arrow batches.

A batch of texts is viewed as one byte array with document offsets; word
boundaries and 64-bit word hashes come from a handful of NumPy passes, so no
Python code runs per word.  Texts are whole: a chunk ends between documents,
never inside one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
CHUNK_ROWS = 4096

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(_BASE))


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def _mask(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


LOWER = _lower_table()
#: Bytes outside [\x20\x09-\x0D]: characters of white-space separated words.
NOT_SPACE = ~_mask((0x20, 0x20), (0x09, 0x0D))
#: Bytes outside [\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, lower-case letters, non-ASCII.
ALNUM = ~_mask((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n + 1 of each."""
    if not _powers or len(_powers[0]) < n + 1:
        m = max(n + 1, CHUNK_BYTES + 1)
        steps = [np.full(m, b, U64) for b in (_BASE, _BASE_INV)]
        for x in steps:
            x[0] = 1
        _powers[:] = [np.cumprod(x, dtype=U64) for x in steps]
    return _powers[0][: n + 1], _powers[1][: n + 1]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about `limit` bytes."""
    data, offs = texts(column)
    at, n = 0, len(offs) - 1
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        end = min(max(end, at + 1), at + rows, n)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def spans(data: np.ndarray, offs: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes in `mask`), and the index of the first word of each document (one more at the end)."""
    inside = mask[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, offs)


def hash_spans(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal bytes wherever they stand."""
    n = len(data)
    up, down = _pow(n)
    h = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[data] * up[:n], out=h[1:])
    return mix64((h[e] - h[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))


def value_sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of values times powers, one more than values; and the powers' inverses, which scale a difference of two sums to what stands between, wherever that is."""
    up, down = _pow(len(values))
    h = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[:-1], out=h[1:])
    return h, down


def roll(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive hashes: len(h) - k + 1 of them."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for i in range(k):
        out *= U64(_BASE)
        out += h[i : i + m]
    return mix64(out + U64(k))


class HashSet:
    """Fixed open-addressing table from non-zero 64-bit keys to positions in `keys`; look-ups are vectorised."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, U64)
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.slots = np.zeros(1 << self.bits, U64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        pos = self._home(keys)
        while len(todo):
            free = self.at[pos] < 0
            t, p = todo[free], pos[free]
            self.at[p] = t  # of several for one slot the last written stays
            won = self.at[p] == t
            self.slots[p[won]] = keys[t[won]]
            left = np.concatenate([todo[~free], t[~won]])
            pos = (np.concatenate([pos[~free], p[~won]]) + 1) & self.mask
            todo = left

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is absent."""
        pos = self._home(keys)
        at = self.at[pos]
        out = np.where((at >= 0) & (self.slots[pos] == keys), at, -1).astype(np.int32)
        todo = np.flatnonzero((out < 0) & (at >= 0))
        pos = pos[todo]
        while len(todo):
            pos = (pos + 1) & self.mask
            at = self.at[pos]
            hit = (at >= 0) & (self.slots[pos] == keys[todo])
            out[todo[hit]] = at[hit]
            on = (at >= 0) & ~hit
            todo, pos = todo[on], pos[on]
        return out
