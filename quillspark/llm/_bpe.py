"""Byte-level BPE over Arrow batches: vectorised pre-tokens, a table of known pre-tokens, the library for the rest.

The pre-tokens are those of the byte-level pattern of the `tokenizers` library: contractions, runs of letters, numbers
or other signs with one blank before them, and runs of white space. Their boundaries are found with array operations
on the UTF-8 bytes. A text that holds a character whose class has changed since Unicode 3.2, one of four bytes, or an
added token's string goes to the library as a whole, so that the counts are always the library's own.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

from quillspark.llm._bytes import HashIndex, bytes_hash, text_buffer

LETTER, NUMBER, OTHER, SPACE, BLANK, BOUND, UNKNOWN = range(7)
_WHITE = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
#: Bytes of text per call of the array kernels, and entries of a worker's cache before it starts anew.
PIECE_BYTES, CACHE_ENTRIES = 1 << 20, 400_000
ENCODED_AT_ONCE = 4096
#: Pre-tokens in a joined text, and joined texts encoded at a time.
JOINED, JOINED_AT_ONCE = 256, 64


@cache
def _classes() -> np.ndarray:
    """Class of each code point below 0x10000."""
    out = np.full(0x10000, UNKNOWN, dtype=np.uint8)
    for c in range(0x10000):
        if c in _WHITE:
            out[c] = BLANK if c == 0x20 else SPACE
            continue
        now, then = unicodedata.category(chr(c))[0], unicodedata.ucd_3_2_0.category(chr(c))
        if c < 0x80 or then[0] == now and then not in ("Cn", "Cs"):
            out[c] = {"L": LETTER, "N": NUMBER}.get(now, OTHER)
    return out


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def added(path: str) -> tuple[bytes, ...]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
        raise ValueError("a byte-level BPE file without normaliser or prefix blank is needed")
    return tuple(t["content"].encode() for t in spec["added_tokens"])


class Pieces:
    """The pre-tokens of some texts, in order: bytes [s, e) of data; first[i] is the first pre-token of text i.

    odd lists the texts that must go to the library whole; they have no pre-tokens here.
    """

    def __init__(self, column: pa.Array, specials: tuple[bytes, ...]):
        offsets, raw = text_buffer(column)
        n = len(offsets) - 1
        data = np.insert(raw, offsets[1:], 0) if n else raw
        starts = offsets + np.arange(n + 1)
        table = _classes()
        cls = table[:256].copy()
        cls[0x80:] = UNKNOWN
        cls = cls[data]
        wide = np.flatnonzero(data >= 0xC0)
        if len(wide):
            pad = np.concatenate([data, np.zeros(3, np.uint8)])
            b, c1, c2 = pad[wide].astype(np.int32), pad[wide + 1] & 0x3F, pad[wide + 2] & 0x3F
            two, three = b < 0xE0, (b >= 0xE0) & (b < 0xF0)
            at = wide[two]
            cls[at] = cls[at + 1] = table[((b[two] & 0x1F) << 6) | c1[two]]
            at = wide[three]
            if len(at):
                cls[at] = cls[at + 1] = cls[at + 2] = table[((b[three] & 0x0F) << 12) | (c1[three].astype(np.int32) << 6) | c2[three]]
        cls[starts[1:] - 1] = BOUND
        odd = np.zeros(n, dtype=bool)
        odd[np.searchsorted(starts, np.flatnonzero(cls == UNKNOWN), side="right") - 1] = True
        whole = raw.tobytes() if specials else b""
        for word in specials:
            i = whole.find(word)
            while i >= 0:
                t = int(np.searchsorted(offsets, i, side="right")) - 1
                odd[t] |= i + len(word) <= offsets[t + 1]
                i = whole.find(word, i + 1)
        del whole
        m = len(data)
        start = np.zeros(m, dtype=bool)
        if m:
            white = (cls == SPACE) | (cls == BLANK)
            kind = np.where(white, SPACE, cls)
            start[0] = True
            start[1:] = kind[1:] != kind[:-1]
            # the last character of white space before something else starts a pre-token of its own
            head = (data & 0xC0) != 0x80
            ends = np.flatnonzero(white[:-1] & ~white[1:] & (kind[1:] != BOUND))
            last = ends.copy()
            for _ in range(2):
                last -= ~head[last]
            start[last] = True
            blank = data[ends] == 0x20
            start[ends[blank] + 1] = False
            quote = np.flatnonzero((data == 0x27) & start)
            if len(quote):
                pad = np.concatenate([data, np.zeros(2, np.uint8)])
                a, b = pad[quote + 1], pad[quote + 2]
                one = (a == 0x73) | (a == 0x74) | (a == 0x6D) | (a == 0x64)
                two = ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)
                for q in (quote[one] + 1, quote[two] + 1):
                    start[q] = False
                for q in (quote[one] + 2, quote[two] + 3):
                    start[q] |= kind[q] == LETTER
            start |= cls == BOUND
        at = np.flatnonzero(start)
        end = np.append(at[1:], m)
        good = cls[at] != BOUND
        if odd.any():
            good &= ~odd[np.searchsorted(starts, at, side="right") - 1]
        self.data, self.s, self.e, self.odd = data, at[good], end[good], np.flatnonzero(odd)
        self.first = np.searchsorted(self.s, starts)
        self.h = bytes_hash(data).slices(self.s, self.e)
        self.lead = lead_bytes(data, self.s, self.e)


def lead_bytes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The first eight bytes of each slice as one number, zeros beyond its end."""
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(pad, (len(data), 8), (1, 1))[s].view("<u8").ravel() if len(s) else np.zeros(0, np.uint64)
    short = np.minimum(e - s, 8)
    mask = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
    return eight & mask[short]


class PieceTable:
    """Known pre-tokens by hash, checked by their first bytes and length; their ids lie one after another."""

    def __init__(self, h, lead, size, off, ids):
        order = np.argsort(h, kind="stable")
        h = h[order]
        once = np.ones(len(h), dtype=bool)
        once[1:] = h[1:] != h[:-1]
        order = order[once]
        self.h, self.lead, self.size, self.ids = h[once], lead[order], size[order], ids
        self.at, self.n = off[:-1][order], np.diff(off)[order].astype(np.int32)
        self.index = HashIndex(self.h)

    def __len__(self) -> int:
        return len(self.h)

    def find(self, h, lead, size) -> np.ndarray:
        at = self.index.find(h)
        if len(self.h):
            wrong = (self.lead[at] != lead) | (self.size[at] != size)
            at[wrong] = -1
        return at

    def plus(self, h, lead, size, off, ids) -> PieceTable:
        out = object.__new__(PieceTable)
        where = np.searchsorted(self.h, h)
        for name, new in (("h", h), ("lead", lead), ("size", size), ("at", off[:-1] + len(self.ids)), ("n", np.diff(off).astype(np.int32))):
            setattr(out, name, np.insert(getattr(self, name), where, new))
        out.ids = np.concatenate([self.ids, ids])
        out.index = HashIndex(out.h)
        return out

    @staticmethod
    def empty() -> PieceTable:
        z = np.zeros(0, np.uint64)
        return PieceTable(z, z, np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32))


def encoded(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of texts encoded by the library, some at a time: its results take a kilobyte and more each."""
    sizes, ids = [np.zeros(1, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
    for i in range(0, len(texts), ENCODED_AT_ONCE):
        some = [x.ids for x in tokenizer(path).encode_batch_fast(texts[i : i + ENCODED_AT_ONCE], add_special_tokens=False)]
        sizes.append(np.array([len(x) for x in some], dtype=np.int64))
        ids.append(np.fromiter((i for x in some for i in x), dtype=np.int32, count=int(sizes[-1].sum())))
    return np.cumsum(np.concatenate(sizes)), np.concatenate(ids)


def encoded_pieces(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same for pre-tokens. A blank and letters is a pre-token wherever it stands, so such ones go to the library
    JOINED at a time, and its tokens come back with the number of their pre-token."""
    plain = [i for i, w in enumerate(words) if len(w) > 1 and w[0] == " " and w[1:].isalpha()]
    n, parts, order = np.zeros(len(words), dtype=np.int64), [], []
    for i in range(0, len(plain), JOINED * JOINED_AT_ONCE):
        groups = [plain[j : j + JOINED] for j in range(i, min(i + JOINED * JOINED_AT_ONCE, len(plain)), JOINED)]
        for own, e in zip(groups, tokenizer(path).encode_batch(["".join(words[x] for x in g) for g in groups], add_special_tokens=False), strict=True):
            count = np.bincount(np.array(e.word_ids, dtype=np.int64), minlength=len(own))
            if len(count) == len(own) and count.all():
                n[own] = count
                parts.append(np.array(e.ids, dtype=np.int32))
                order += own
    rest = np.flatnonzero(n == 0)
    if len(rest):
        off, ids = encoded(path, [words[i] for i in rest.tolist()])
        n[rest] = np.diff(off)
        parts.append(ids)
        order += rest.tolist()
    order, ids = np.array(order, dtype=np.int64), np.concatenate(parts) if parts else np.zeros(0, np.int32)
    at = np.zeros(len(words), dtype=np.int64)
    at[order] = np.cumsum(n[order]) - n[order]
    return np.concatenate([[0], np.cumsum(n)]), ids[ragged(at, n)]


def strings(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(s.tolist(), e.tolist(), strict=True)]


def ragged(off: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions off[0] .. off[0] + n[0] - 1, off[1] .., one after another."""
    total = int(n.sum())
    first = np.cumsum(n) - n
    return np.repeat(off - first, n) + np.arange(total)


class Encoder:
    """Two tiers: a broadcast table of frequent pre-tokens, and a cache of this worker for what that misses."""

    _caches: dict[str, PieceTable] = {}

    def __init__(self, path: str, frequent: PieceTable):
        self.path, self.frequent, self.specials = path, frequent, added(path)

    def _rows(self, p: Pieces):
        """For each pre-token, its ids: position and count, in the frequent table or (from len(ids) on) the cache."""
        size = p.e - p.s
        row = self.frequent.find(p.h, p.lead, size)
        at, n = self.frequent.at[row] if len(self.frequent) else row.copy(), self.frequent.n[row].astype(np.int64) if len(self.frequent) else row.copy()
        miss = np.flatnonzero(row < 0)
        cache = self._caches.get(self.path)
        if cache is None or len(cache) > CACHE_ENTRIES:
            cache = PieceTable.empty()
        extra = np.zeros(0, np.int32)
        if len(miss):
            h, lead, size = p.h[miss], p.lead[miss], size[miss]
            row = cache.find(h, lead, size)
            new = np.flatnonzero(row < 0)
            if len(new):
                _, one = np.unique(h[new], return_index=True)
                one = new[one]
                off, ids = encoded_pieces(self.path, strings(p.data, p.s[miss[one]], p.e[miss[one]]))
                fresh = cache.index.find(h[one]) < 0
                pick = np.flatnonzero(fresh)
                if len(pick):
                    k = np.diff(off)[pick]
                    cache = cache.plus(h[one][pick], lead[one][pick], size[one][pick], np.concatenate([[0], np.cumsum(k)]), ids[ragged(off[:-1][pick], k)])
                row = cache.find(h, lead, size)
                clash = np.flatnonzero(row < 0)  # another pre-token has the same hash: encoded anew each time
                if len(clash):
                    off, extra = encoded(self.path, strings(p.data, p.s[miss[clash]], p.e[miss[clash]]))
            at[miss], n[miss] = cache.at[row] + len(self.frequent.ids), cache.n[row]
            if len(new) and len(clash):
                at[miss[clash]], n[miss[clash]] = off[:-1] + len(self.frequent.ids) + len(cache.ids), np.diff(off)
        self._caches[self.path] = cache
        return at, n, cache, extra

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        p = Pieces(column, self.specials)
        _, n, _, _ = self._rows(p)
        out = np.diff(np.concatenate([[0], np.cumsum(n)])[p.first])
        if len(p.odd):
            off, _ = encoded(self.path, column.take(pa.array(p.odd)).to_pylist())
            out[p.odd] = np.diff(off)
        return out

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each text, all ids)."""
        p = Pieces(column, self.specials)
        at, n, cache, extra = self._rows(p)
        pool = np.concatenate([self.frequent.ids, cache.ids, extra])
        flat = pool[ragged(at, n)]
        k = np.diff(np.concatenate([[0], np.cumsum(n)])[p.first])
        if len(p.odd):
            off, more = encoded(self.path, column.take(pa.array(p.odd)).to_pylist())
            before = np.cumsum(k)[p.odd]
            flat = np.insert(flat, np.repeat(before, np.diff(off)), more)
            k[p.odd] = np.diff(off)
        return k, flat
