"""Vectorised byte and word kernels used inside Arrow functions.

Texts arrive as Arrow string arrays. They are laid out as one uint8 buffer in which every text is followed by one
separator byte, so that no word, window or n-gram can cross two texts. Hashes are sums of random 64-bit values times
powers of an odd base (mod 2**64), read off a running sum, so that the hash of any slice costs O(1).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEP = 0x20
_rng = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE2 = 0xD6E8FEB86659FD93
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _pow(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**n (or of its inverse), mod 2**64; kept and extended by doubling."""
    have = _powers.get((base, inverse))
    if have is None or len(have) <= n:
        b = pow(base, -1, 2**64) if inverse else base
        have = np.ones(1, dtype=np.uint64)
        while len(have) <= n:
            have = np.concatenate([have, have * np.uint64(pow(b, len(have), 2**64))])
        _powers[base, inverse] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Running:
    """Hashes of slices [s, e) of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int = _BASE):
        n = len(values)
        self.base, self.sum = base, np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * _pow(base, n)[:n], out=self.sum[1:])
        self.inv = _pow(base, n, True)

    def slices(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        h = (self.sum[e] - self.sum[s]) * self.inv[s]
        return mix(h + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def bytes_hash(data: np.ndarray, base: int = _BASE) -> Running:
    return Running(_BYTE[data], base)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of n + 1 entries, uint8 data) of a string array without nulls, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def pieces(column: pa.Array, most: int = 1 << 20):
    """(first row, row after the last) so that each piece holds at most `most` bytes, or one text."""
    offsets, _ = text_buffer(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def separated(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data with SEP after each text, starts of n + 1 entries: text i is data[starts[i] : starts[i + 1] - 1])."""
    offsets, raw = text_buffer(column)
    n = len(offsets) - 1
    data = np.insert(raw, offsets[1:], SEP) if n else raw
    return data, offsets + np.arange(n + 1)


#: Classes of word bytes; bytes of multi-byte characters (>= 0x80) always belong to words.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[data]


class Words:
    """The words of some texts: slices of the buffer, the text of each, and a 64-bit hash of each."""

    def __init__(self, column: pa.Array, inside: np.ndarray, lowered: bool):
        data, starts = separated(column)
        self.data = lower(data) if lowered else data
        mask = np.zeros(len(data) + 2, dtype=bool)
        mask[1:-1] = inside[self.data]
        edge = np.flatnonzero(mask[1:] != mask[:-1])
        self.s, self.e = edge[0::2], edge[1::2]
        #: Words first[i] .. first[i + 1] - 1 are those of text i.
        self.first = np.searchsorted(self.s, starts)
        self.counts = np.diff(self.first)
        self.h = bytes_hash(self.data).slices(self.s, self.e)

    def __len__(self) -> int:
        return len(self.s)

    def room(self) -> np.ndarray:
        """For each word, how many words of its text start there or later."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self))

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[0::2], edge[1::2]


def cover(n: int, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Boolean array of n entries, True inside any [s, e)."""
    d = np.zeros(n + 1, dtype=np.int64)
    np.add.at(d, s, 1)
    np.add.at(d, e, -1)
    return np.cumsum(d[:-1]) > 0


class HashIndex:
    """A sorted array of distinct 64-bit hashes with a table of first positions by leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, min(24, int(len(keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        count = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.start = np.zeros(len(count) + 1, dtype=np.int32 if len(keys) < 2**31 else np.int64)
        np.cumsum(count, out=self.start[1:])

    def find(self, q: np.ndarray) -> np.ndarray:
        """Position of each query among the keys, -1 if absent."""
        out = np.full(len(q), -1, dtype=np.int64)
        if not len(self.keys) or not len(q):
            return out
        top = (q >> self.shift).astype(np.int64)
        at, end = self.start[top].astype(np.int64), self.start[top + 1]
        rest = np.flatnonzero(at < end)
        at, end, q = at[rest], end[rest], q[rest]
        while len(rest):
            hit = self.keys[at] == q
            out[rest[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end)
            rest, at, end, q = rest[more], at[more], end[more], q[more]
        return out


def rows_of(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
