"""Substring dedup by a run-length index over the repetitive part of a corpus.

1. Every window of WINDOW bytes picks an anchor, the smallest K-gram hash in it, so equal windows pick equal anchors.
   Windows of one anchor form a context: a slice of the text in which each of them lies, split by which side of the
   anchor is long. Its key is a hash of the anchor and the bytes that all windows of that side share. Each block sends
   its keys with the hashes of their contexts, at most BLOCK_CONTEXTS a key. Contexts whose key the corpus has once
   cannot repeat and go no further. Where a block has more contexts of a key, the bucket asks it for all of them, or,
   if the key may have more than MOST_CONTEXTS different ones (a common line shorter than a window), has the key split:
   its windows form contexts of a tenth of the width, whose keys take in more bytes, and so on; at the last depth a
   context is one window and its key the whole of it. Both limits are the same at every size. Blocks keep the split keys
   of all depths and form narrower contexts of their windows only, so a key that is split costs its own windows and not
   all of the text's, and there are three depths at most.
2. Equal contexts under a key are one row with a multiplicity, as equal runs are in a run-length index; every window of
   a context that occurs twice repeats. Contexts that share their key only with different ones, and one copy of each
   different one, go to the index of their bucket.
3. An index is the Burrows-Wheeler transform of its contexts in runs, with the suffix position at each run's first and
   last row and the length of the match with the neighbouring row there; the suffix array is dropped once they are
   taken. Inside a run, a step to the preceding byte keeps neighbours and lengthens their match by one, so streaming
   over the text, the longest match that starts at a position is the sampled length at the last run boundary before it
   less the distance, on either side; positions where it reaches WINDOW start long matches. Only contexts of one key
   can match, so an index works on whole keys, INDEX_BYTES at a time.

Each window lies in exactly one context, so an index never sees the same place of the corpus twice.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._blocks import bucket_of, in_blocks, number, slimmed, spans, split_keys, with_block
from quillspark.llm._bpe import ragged
from quillspark.llm._bytes import HashIndex, bytes_hash, cover, mix, pieces, rows_of, separated
from quillspark.llm._spark import slim, stored, table

WINDOW, GRAM = 200, 32
#: Bytes of contexts of an index bucket on average, and most bytes (or one key) that are indexed at a time.
BUCKET_BYTES, INDEX_BYTES = 8 << 20, 1 << 20
#: Bytes of text worked on at a time (or one text).
PIECE_BYTES = 1 << 19
FULL, EDGE, COPY = 1, 2, 3
#: Contexts of a key that a block sends unasked, and different contexts beyond which a key is split.
BLOCK_CONTEXTS, MOST_CONTEXTS = 8, 4096
#: Parts that the range of a split key is cut into: each further depth is one more pass over the texts.
SPLIT = 10


def _ranges(slack: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth, the first and last distance from window start to anchor of the range that a distance falls to."""
    out, ranges = [], [(0, slack // 2), (slack // 2 + 1, slack)]
    while True:
        lo, hi = np.zeros(slack + 1, np.int64), np.zeros(slack + 1, np.int64)
        for a, b in ranges:
            lo[a : b + 1], hi[a : b + 1] = a, b
        out.append((lo, hi))
        if all(a == b for a, b in ranges):
            return out
        ranges = [(x, min(x + step, b + 1) - 1) for a, b in ranges for step in [-(-(b - a + 1) // SPLIT)] for x in range(a, b + 1, step)]


class Contexts:
    """The contexts of some texts: key, content hash, first window, number of windows."""

    def __init__(self, column: pa.Array, window: int = WINDOW, gram: int = GRAM):
        self.data, self.starts = separated(column)
        n, w = len(self.data), window - gram + 1
        self.run, self.window, self.ranges = bytes_hash(self.data), window, _ranges(window - gram)
        self.start = self.pick = np.zeros(0, np.int64)
        self._form(0, self.start, self.pick)
        room = np.repeat(self.starts[1:] - 1, np.diff(self.starts)) - np.arange(n)
        ok = room >= window
        if not ok.any():
            return
        at = np.arange(n - gram + 1)
        # the same bits at every size, ties to the first position, so that equal windows pick equal anchors
        low_bits = np.uint64((1 << 32) - 1)
        value = (self.run.slices(at, at + gram) & ~low_bits) | at.astype(np.uint64)
        m = -(-len(value) // w) * w
        grid = np.full(m, np.uint64(2**64 - 1))
        grid[: len(value)] = value
        ahead = np.minimum.accumulate(grid.reshape(-1, w), axis=1).ravel()
        behind = np.minimum.accumulate(grid.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
        self.start = np.flatnonzero(ok)
        low = np.minimum(behind[self.start], ahead[self.start + w - 1])
        self.pick = (low & low_bits).astype(np.int64)
        self._form(0, self.start, self.pick)

    def depths(self, splits: list[HashIndex]):
        """Itself with its contexts of each depth: all at the first, then those of windows whose key was split."""
        start, pick = self.start, self.pick
        yield self
        for depth, split in enumerate(splits, 1):
            own = np.repeat(split.find(self.key) >= 0, self.n)
            start, pick = start[own], pick[own]
            if not len(start):
                return
            self._form(depth, start, pick)
            yield self

    def _form(self, depth: int, start: np.ndarray, pick: np.ndarray) -> None:
        """Contexts of windows side by side with the same anchor and the same range of distances to it."""
        lo, hi = self.ranges[depth]
        side = lo[pick - start]
        head = np.ones(len(start), dtype=bool)
        head[1:] = (pick[1:] != pick[:-1]) | (side[1:] != side[:-1]) | (start[1:] != start[:-1] + 1)
        where = np.flatnonzero(head)
        self.first, self.n = start[where], np.diff(np.append(where, len(start)))
        self.anchor, self.near = pick[where], pick[where] - start[where]
        lo, hi = lo[self.near], hi[self.near]
        # the bytes that all windows of the range share, and the range
        self.key = mix(self.run.slices(self.anchor - lo, self.anchor - hi + self.window) + (lo * 512 + hi).astype(np.uint64))
        self.hash = mix(self.run.slices(self.first, self.first + self.n - 1 + self.window) + (self.anchor - self.first).astype(np.uint64))


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of some strings, sampled at the ends of its runs."""

    def __init__(self, text: np.ndarray, ends: np.ndarray):
        """ends: for each byte of text, where its string ends. Equal suffixes lie in the order of their strings."""
        n = len(text)
        ends = ends.astype(np.int32)
        depth = int((ends - np.arange(n, dtype=np.int32)).max(initial=0))
        self.n, self.ends = n, ends
        order = _suffixes(text, ends, depth)
        before = np.full(n, 256, dtype=np.int16)
        before[1:] = text[:-1]
        before[np.flatnonzero(np.diff(ends, prepend=-1))] = 256  # no byte stands before the start of a string
        bwt = before[order]
        head = np.ones(n, dtype=bool)
        head[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 256)
        run = np.flatnonzero(head)
        last = np.append(run[1:], n) - 1
        self.run_byte, self.run_size = bwt[run], np.diff(np.append(run, n))
        # rows at run heads meet the row above, rows at run ends the row below
        self.head_at, self.last_at = order[run], order[last]
        above, below = order[np.maximum(run - 1, 0)], order[np.minimum(last + 1, n - 1)]
        del order, bwt, before
        self.head_len = np.where(run > 0, _common(text, ends, self.head_at, above, depth), 0)
        self.last_len = np.where(last < n - 1, _common(text, ends, self.last_at, below, depth), 0)

    def longest(self) -> np.ndarray:
        """Length of the longest match elsewhere of what starts at each position, streamed from the samples."""
        place = np.arange(self.n, dtype=np.int32)
        out = np.zeros(self.n, dtype=np.int32)
        for at, length in ((self.head_at, self.head_len), (self.last_at, self.last_len)):
            reach = np.full(self.n, -1, dtype=np.int32)
            reach[at] = at + length
            seen = np.full(self.n, -1, dtype=np.int32)
            seen[at] = at
            seen = np.maximum.accumulate(seen)
            out = np.maximum(out, np.where(seen >= 0, reach[np.maximum(seen, 0)] - place, 0))
        return np.minimum(out, self.ends - place)


def _suffixes(text: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in order of their first `depth` bytes or up to their string's end; by prefix doubling."""
    n = len(text)
    place = np.arange(n, dtype=np.int32)
    left = ends - place
    pad = np.concatenate([text, np.zeros(8, np.uint8)])
    value = np.lib.stride_tricks.as_strided(pad, (n, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)
    short = np.minimum(left, 8).astype(np.uint8)
    mask = np.array([((1 << (8 * k)) - 1) << (8 * (8 - k)) for k in range(9)], dtype=np.uint64)
    value &= mask[short]
    order = (np.lexsort((short, value)) if (text == 0).any() else np.argsort(value, kind="stable")).astype(np.int32)
    ranked, short = value[order], short[order]
    same = np.zeros(n, dtype=bool)
    same[1:] = (ranked[1:] == ranked[:-1]) & (short[1:] == short[:-1])
    del value, ranked, short, pad
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(same, 0, place))
    size = 8
    while True:
        # rank: row of the first of those equal so far
        tied = same.copy()
        tied[:-1] |= same[1:]
        tied = np.flatnonzero(tied)
        if size >= depth or not len(tied):
            return order
        at = order[tied]
        first = rank[at].astype(np.int64)
        next_ = np.where(left[at] > size, rank[np.minimum(at + size, n - 1)] + 1, 0)
        by = np.argsort(first * (n + 1) + next_, kind="stable")
        at, first, next_ = at[by], first[by], next_[by]
        order[tied] = at
        again = np.zeros(len(at), dtype=bool)
        again[1:] = (first[1:] == first[:-1]) & (next_[1:] == next_[:-1])
        same[tied] = again
        rank[at] = np.maximum.accumulate(np.where(again, 0, tied))
        size *= 2


def _common(text: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to depth and their strings' ends."""
    most = np.minimum(np.minimum(ends[a] - a, ends[b] - b), depth)
    out = np.zeros(len(a), dtype=np.int32)
    pad = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(pad, (len(text), 8), (1, 1))
    rest = np.flatnonzero((most > 0) & (a != b))
    while len(rest):
        x = a[rest] + out[rest]
        y = b[rest] + out[rest]
        differ = eight[x] != eight[y]
        any_ = differ.any(axis=1)
        step = np.where(any_, differ.argmax(axis=1), 8)
        out[rest] += step
        rest = rest[~any_ & (out[rest] < most[rest])]
    return np.minimum(out, most)


SENT = "bucket int, block int, whole int, keys binary, kinds binary, hashes binary, twice binary"
MET = "block int, keys binary, hashes binary, states binary, ask binary, split binary"
TEXTS = "index int, block int, keys binary, hashes binary, states binary, sizes binary, bytes binary"
FOUND = "block int, keys binary, hashes binary, sizes binary, marks binary"


def _table(schema: str, rows: list) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[] for _ in schema.split(", ")]
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)


def _column(table_: pa.Table, name: str, kind) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for x in rows_of(table_, name).to_pylist() if x is not None]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _per_key(table_: pa.Table, name: str) -> np.ndarray:
    """The value of an int column for each key of each row."""
    return np.repeat(np.array(rows_of(table_, name).to_pylist(), dtype=np.int64), [len(x) // 8 for x in rows_of(table_, "keys").to_pylist()])


def _by_block(block: np.ndarray):
    """(block, positions) of each block, from one sort."""
    order = np.argsort(block, kind="stable")
    for b, x, y in spans(block[order]):
        yield b, order[x:y]


def _send(block: int, pairs: np.ndarray, n_buckets: int, whole: int) -> list:
    """Rows of the keys of a block's contexts, each once, with how many different contexts it has there, and their hashes
    if they are at most BLOCK_CONTEXTS, or all of them if `whole`."""
    pairs, count = _unique_pairs(pairs)
    keys, first, kinds = np.unique(pairs[:, 0], return_index=True, return_counts=True)
    given = kinds if whole else np.where(kinds <= BLOCK_CONTEXTS, kinds, 0)
    sent = np.repeat(given > 0, kinds)
    hashes, twice, at = pairs[sent, 1], count[sent] > 1, np.concatenate([[0], np.cumsum(given)])
    kinds = np.minimum(kinds, 65535).astype(np.uint16)
    return [(b, block, whole, keys[x:y].tobytes(), kinds[x:y].tobytes(), hashes[at[x] : at[y]].tobytes(), twice[at[x] : at[y]].tobytes()) for b, x, y in split_keys(keys, n_buckets)]


def _meet(table_: pa.Table) -> pa.Table:
    """To each block, its contexts that may repeat with their states (FULL, EDGE, or COPY: full, and to be sent to the
    index), the keys of which it is to send all contexts, and those to be split."""
    keys, kinds, block, whole = _column(table_, "keys", np.uint64), _column(table_, "kinds", np.uint16).astype(np.int64), _per_key(table_, "block"), _per_key(table_, "whole")
    given = np.where((whole > 0) | (kinds <= BLOCK_CONTEXTS), kinds, 0)
    found, at = np.unique(keys, return_inverse=True)
    # contexts that came with their hashes, in the order of keys, hashes and blocks
    owner = np.repeat(np.arange(len(keys)), given)
    hashes, twice = _column(table_, "hashes", np.uint64), _column(table_, "twice", np.uint8).astype(np.int64)
    order = np.lexsort((block[owner], hashes, at[owner]))
    k, h, owner, twice = at[owner[order]], hashes[order], owner[order], twice[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
    pair = np.cumsum(new) - 1
    full = np.bincount(pair, 1 + twice)[pair] > 1 if len(k) else new
    # of each key: contexts that stayed behind, different ones at most, those that occur once, and occurrences
    behind = np.bincount(at, kinds * (given == 0), len(found))
    distinct = np.bincount(k, new, len(found)) + behind
    edges = np.bincount(k, ~full, len(found))
    shared = np.bincount(k, 1 + twice, len(found)) + behind > 1
    split = shared & (distinct > MOST_CONTEXTS)
    ask = shared & ~split & (behind > 0)
    state = np.where(full, np.where(new & (edges[k] > 0), COPY, FULL), np.where(distinct[k] > 1, EDGE, 0)).astype(np.uint8)
    good = (state > 0) & ~(split | ask)[k]
    rows: dict[int, list] = {}
    states = np.flatnonzero(good)
    for b, own in _by_block(block[owner[states]]):
        own = states[own]
        rows[b] = [found[k[own]].tobytes(), h[own].tobytes(), state[own].tobytes(), b"", b""]
    for x, marked in ((3, ask), (4, split)):
        some = np.flatnonzero(marked[at])
        for b, own in _by_block(block[some]):
            rows.setdefault(b, [b""] * 5)[x] = keys[some[own]].tobytes()
    return _table(MET, [(b, *x) for b, x in rows.items()])


def _indexed(window: int):
    def index(table_: pa.Table) -> pa.Table:
        """Indexes the contexts of a bucket, whole keys at a time, and returns which windows of each EDGE context repeat."""
        keys, hashes, states = _column(table_, "keys", np.uint64), _column(table_, "hashes", np.uint64), _column(table_, "states", np.uint8)
        sizes, text, block = _column(table_, "sizes", np.int32).astype(np.int64), _column(table_, "bytes", np.uint8), _per_key(table_, "block")
        start = np.cumsum(sizes) - sizes
        order = np.lexsort((hashes, keys))
        head = np.ones(len(order), dtype=bool)
        head[1:] = keys[order][1:] != keys[order][:-1]
        # the bytes before each key; a part begins with the first key past each multiple of INDEX_BYTES
        before = (np.cumsum(sizes[order]) - sizes[order])[head] // INDEX_BYTES
        rows, marks = [], []
        for _, x, y in spans(before[np.cumsum(head) - 1]):
            own = order[x:y]
            size = sizes[own]
            at = np.cumsum(size) - size
            longest = RunIndex(text[ragged(start[own], size)], np.repeat(at + size, size)).longest()
            edge = np.flatnonzero(states[own] == EDGE)
            n = size[edge] - window + 1
            repeats = longest[ragged(at[edge], n)] >= window
            some = np.add.reduceat(repeats, np.cumsum(n) - n) > 0 if len(edge) else np.zeros(0, bool)
            rows.append(own[edge[some]])
            marks.append(repeats[np.repeat(some, n)])
        rows, marks = np.concatenate(rows), np.concatenate(marks)
        n = sizes[rows] - window + 1
        first, out = np.cumsum(n) - n, []
        for b, own in _by_block(block[rows]):
            at = rows[own]
            out.append((b, keys[at].tobytes(), hashes[at].tobytes(), n[own].astype(np.int32).tobytes(), np.packbits(marks[ragged(first[own], n[own])]).tobytes()))
        return _table(FOUND, out)

    return index


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes; null counts as empty. A byte is removed if a string of `window` bytes that covers it also
    starts anywhere else, in the same text (overlapping itself too) or another; no string crosses two texts, and
    strings are judged on the input. n_spans counts maximal removed runs. A row that repeats (same id and text)
    makes all its windows repeated.
    """
    cut = in_blocks(slim(docs, doc_id, text))
    blocks, n_buckets = cut.docs, cut.buckets(cut.bytes // 40)

    def parts(docs_: pa.Table):
        column = rows_of(docs_, "text")
        for i, j in pieces(column, PIECE_BYTES):
            yield Contexts(column.slice(i, j - i), window)

    def first(docs_: pa.Table) -> pa.Table:
        return _table(SENT, _send(number(docs_, "block"), np.concatenate([np.column_stack([c.key, c.hash]) for c in parts(docs_)]), n_buckets, 0))

    def further(depth: int):
        def send(docs_: pa.Table, back: pa.Table) -> pa.Table:
            """All contexts of the keys that were asked for at the depth before, and narrower ones of those to be split."""
            if not docs_.num_rows or not back.num_rows:
                return _table(SENT, [])
            ask, splits = HashIndex(np.unique(_column(back, "ask", np.uint64))), _splits(back)
            if not len(ask.keys) and len(splits) < depth:
                return _table(SENT, [])
            block, asked, narrower = number(docs_, "block"), [np.zeros((0, 2), np.uint64)], [np.zeros((0, 2), np.uint64)]
            for c in parts(docs_):
                for d, c in enumerate(c.depths(splits)):
                    if d == depth - 1:
                        own = ask.find(c.key) >= 0
                        asked.append(np.column_stack([c.key[own], c.hash[own]]))
                    elif d == depth:
                        narrower.append(np.column_stack([c.key, c.hash]))
            return _table(SENT, _send(block, np.concatenate(asked), n_buckets, 1) + _send(block, np.concatenate(narrower), n_buckets, 0))

        return send

    def third(n_indexes: int):
        def send_texts(docs_: pa.Table, back: pa.Table) -> pa.Table:
            if not docs_.num_rows or not back.num_rows:
                return _table(TEXTS, [])
            known, _, states = _lookup(back)
            splits = _splits(back)
            copied, out = np.zeros(len(states), dtype=bool), []
            for c in (c for part in parts(docs_) for c in part.depths(splits)):
                row = known.find(c.key ^ mix(c.hash))
                state = np.where(row >= 0, states[row], 0) if len(states) else np.zeros(len(row), np.uint8)
                # one copy of a context that occurs several times
                copy = np.flatnonzero(state == COPY)
                _, once = np.unique(row[copy], return_index=True)
                copy = copy[once][~copied[row[copy[once]]]]
                copied[row[copy]] = True
                x = np.concatenate([np.flatnonzero(state == EDGE), copy])
                size = c.n[x] - 1 + window
                out.append((bucket_of(c.key[x], n_indexes), c.key[x], c.hash[x], state[x].astype(np.uint8), size.astype(np.int32), c.data[ragged(c.first[x], size)]))
            to, key, hash_, state, size, raw = (np.concatenate(x) for x in zip(*out, strict=True))
            at = np.cumsum(size, dtype=np.int64) - size
            return _table(TEXTS, [
                (b, number(docs_, "block"), key[own].tobytes(), hash_[own].tobytes(), state[own].tobytes(), size[own].tobytes(), raw[ragged(at[own], size[own])].tobytes()) for b, own in _by_block(to)
            ])

        return send_texts

    def last(docs_: pa.Table, back: pa.Table) -> pa.Table:
        ids, out = rows_of(docs_, "doc_id"), [[], [], [], []]
        known, _, states = _lookup(back)
        splits = _splits(back)
        some = [x is not None for x in rows_of(back, "marks").to_pylist()] if back.num_rows else []
        found = back.filter(pa.array(some, pa.bool_()))
        marked = HashIndex(np.zeros(0, np.uint64))
        if found.num_rows:
            keys = _column(found, "keys", np.uint64) ^ mix(_column(found, "hashes", np.uint64))
            n = _column(found, "sizes", np.int32).astype(np.int64)
            counts = [len(x) // 4 for x in rows_of(found, "sizes").to_pylist()]
            bits, i = [], 0
            for x, k in zip(rows_of(found, "marks").to_pylist(), counts, strict=True):
                bits.append(np.unpackbits(np.frombuffer(x, np.uint8), count=int(n[i : i + k].sum())).astype(bool))
                i += k
            bits, order = np.concatenate(bits), np.argsort(keys)
            marked, at, n = HashIndex(keys[order]), (np.cumsum(n) - n)[order], n[order]
        for c in parts(docs_):
            gone = np.zeros(len(c.data), dtype=bool)
            for c in c.depths(splits):
                both = c.key ^ mix(c.hash)
                row = known.find(both)
                full = np.flatnonzero((row >= 0) & (states[row] != EDGE)) if len(states) else np.zeros(0, np.int64)
                gone |= cover(len(c.data), c.first[full], c.first[full] + c.n[full] - 1 + window)
                row = marked.find(both)
                edge = np.flatnonzero(row >= 0)
                if len(edge):
                    k = n[row[edge]]
                    start = ragged(c.first[edge], k)[bits[ragged(at[row[edge]], k)]]
                    gone |= cover(len(c.data), start, start + window)
            keep = ~gone
            keep[c.starts[1:] - 1] = False
            plain, kept = c.data[keep].tobytes(), np.concatenate([[0], np.cumsum(keep)])[c.starts]
            head = gone & ~np.concatenate([[False], gone[:-1]])
            removed, spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[c.starts]) for x in (gone, head))
            out[0] += (np.diff(c.starts) - 1).tolist()
            out[1] += removed.tolist()
            out[2] += spans.tolist()
            out[3] += [hashlib.sha256(plain[x:y]).hexdigest() for x, y in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]
        return pa.table([ids, *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    met, depth = [], 0
    sent = blocks.groupBy("block").applyInArrow(slimmed(first), SENT)
    while True:
        met.append(stored(sent.groupBy("bucket").applyInArrow(slimmed(_meet), MET), "contexts"))
        depth += 1
        open_ = met[-1].where("length(ask) + length(split) > 0").select("block", "ask", F.lit(depth - 1).alias("depth"), "split")
        if open_.limit(1).count() == 0:
            break
        past = [m.where("length(split) > 0").select("block", F.lit(None).cast("binary").alias("ask"), F.lit(d).alias("depth"), "split") for d, m in enumerate(met[:-1])]
        sent = with_block(blocks, reduce(DataFrame.unionAll, [open_, *past]), further(depth), SENT)
    states = reduce(DataFrame.unionAll, met).where("length(states) > 0").select("block", "keys", "hashes", "states")
    # as many indexes as the contexts to be indexed need: their number follows from the states
    n_contexts = states.select(F.sum(F.length(F.regexp_replace(F.hex("states"), "01", "")) / 2).alias("n")).first()["n"] or 0
    n_indexes = max(4, int(n_contexts * (window + 45)) // BUCKET_BYTES + 1)
    splits = reduce(DataFrame.unionAll, [m.where("length(split) > 0").select("block", F.lit(d).alias("depth"), "split") for d, m in enumerate(met)])
    known = states.unionByName(splits, allowMissingColumns=True)
    texts = with_block(blocks, known, third(n_indexes), TEXTS)
    found = texts.groupBy("index").applyInArrow(slimmed(_indexed(window)), FOUND)
    back = known.unionByName(found, allowMissingColumns=True)
    return with_block(blocks, back, last, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _unique_pairs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(pairs):
        return pairs.reshape(0, 2).astype(np.uint64), np.zeros(0, np.int64)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    head = np.ones(len(pairs), dtype=bool)
    head[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    at = np.flatnonzero(head)
    return pairs[at], np.diff(np.append(at, len(pairs)))


def _splits(back: pa.Table) -> list[HashIndex]:
    """The split keys of each depth that came back to a block."""
    own = back.filter(pa.array([bool(x) for x in rows_of(back, "split").to_pylist()], pa.bool_())) if back.num_rows else back
    depth = np.array(rows_of(own, "depth").to_pylist(), dtype=np.int64)
    return [HashIndex(np.unique(_column(own.filter(pa.array(depth == d)), "split", np.uint64))) for d in range(int(depth.max(initial=-1)) + 1)]


def _lookup(back: pa.Table) -> tuple[HashIndex, np.ndarray, np.ndarray]:
    """(index by key and content, hashes, states) of the contexts that came back with a state."""
    own = back.filter(pa.array([x is not None for x in rows_of(back, "states").to_pylist()], pa.bool_())) if back.num_rows else back
    if not own.num_rows:
        return HashIndex(np.zeros(0, np.uint64)), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    keys, hashes, states = _column(own, "keys", np.uint64), _column(own, "hashes", np.uint64), _column(own, "states", np.uint8)
    both = keys ^ mix(hashes)
    order = np.argsort(both)
    return HashIndex(both[order]), hashes[order], states[order]


def op2_run_index(spark, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


SQL = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS v FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM h)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY v) AS n FROM p) WHERE n > 1),
o AS (SELECT doc_id, i, max(i + 200) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
s AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR before < i THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM o),
m AS (SELECT doc_id, span, min(i) AS a, max(i) + 200 AS b FROM s GROUP BY doc_id, span),
g AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS past FROM m),
k AS (SELECT h.doc_id, string_agg(substr(h, 2 * past + 1, 2 * (a - past)), '' ORDER BY a) AS x, max(b) AS b, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM h JOIN g ON g.doc_id = h.doc_id GROUP BY h.doc_id)
SELECT h.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(x || substr(h, 2 * b + 1), h))) AS kept_sha256
FROM h LEFT JOIN k ON k.doc_id = h.doc_id
"""
