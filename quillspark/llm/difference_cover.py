"""Substring dedup on words with difference-cover anchors.

D is a difference cover modulo PERIOD: for any two positions some shift below PERIOD brings both to a residue in D.
Short windows are hashed only at positions whose residue is in D, so any two equal long windows share a short window
that both sample at the same shift. Short windows that the corpus has once are dropped; around the others the match is
extended to the whole long window, whose hash is compared across the corpus, and every word of a repeated one goes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm._blocks import SENT, in_blocks, joined_keys, number, send, shared_keys, with_block
from quillspark.llm._bytes import NOT_SPACE, HashIndex, Running, Words, cover, pieces, rows_of
from quillspark.llm._spark import slim, table

WINDOW, PERIOD = 35, 21
#: A perfect difference set modulo 21.
COVER = (3, 6, 7, 12, 14)


def is_cover(residues: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in residues for b in residues} == set(range(period))


class Anchored:
    """The words of some texts with their sampled short windows and their long windows."""

    def __init__(self, column: pa.Array, window: int = WINDOW, period: int = PERIOD, residues: tuple[int, ...] = COVER):
        self.words = Words(column, NOT_SPACE, lowered=False)
        self.window, self.period, self.short = window, period, window - period + 1
        self.seq, self.room = Running(self.words.h), self.words.room()
        inside = np.arange(len(self.words)) - np.repeat(self.words.first[:-1], self.words.counts)
        sampled = np.zeros(period, dtype=bool)
        sampled[list(residues)] = True
        self.at = np.flatnonzero(sampled[inside % period] & (self.room >= self.short))
        self.long_at = np.flatnonzero(self.room >= window)

    def anchors(self) -> np.ndarray:
        return self.seq.slices(self.at, self.at + self.short)

    def windows(self, at: np.ndarray) -> np.ndarray:
        return self.seq.slices(at, at + self.window)

    def extended(self, shared: HashIndex) -> np.ndarray:
        """Starts of long windows that hold a shared anchor within the first `period` positions."""
        hit = self.at[shared.find(self.anchors()) >= 0]
        near = np.searchsorted(hit, self.long_at)
        ok = near < len(hit)
        ok[ok] = hit[near[ok]] < self.long_at[ok] + self.period
        return self.long_at[ok]


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, period: int = PERIOD, residues: tuple[int, ...] = COVER) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, n_spans.

    Words are maximal runs of other characters than ASCII white space, unchanged. A word is removed if a window of
    `window` words that covers it also starts anywhere else, in the same text or another; windows are judged on the
    input. Null and empty texts have no words. A row that repeats (same id and text) makes all its windows repeated.
    """
    if window <= period or not is_cover(residues, period):
        raise ValueError("residues must be a difference cover modulo a period shorter than the window")
    cut = in_blocks(slim(docs, doc_id, text))
    blocks, n_buckets = cut.docs, cut.buckets(cut.bytes // 24)

    def parts(column: pa.Array):
        for i, j in pieces(column):
            yield i, j, Anchored(column.slice(i, j - i), window, period, residues)

    def first(docs_: pa.Table) -> pa.Table:
        keys = [a.anchors() for _, _, a in parts(rows_of(docs_, "text"))]
        return send(number(docs_, "block"), np.concatenate(keys), n_buckets)

    def second(docs_: pa.Table, back: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return send(0, np.zeros(0, np.uint64), n_buckets)
        shared = HashIndex(joined_keys(back))
        keys = [a.windows(a.extended(shared)) for _, _, a in parts(rows_of(docs_, "text"))]
        return send(number(docs_, "block"), np.concatenate(keys), n_buckets)

    def last(docs_: pa.Table, back: pa.Table) -> pa.Table:
        shared = HashIndex(joined_keys(back))
        ids, out = rows_of(docs_, "doc_id"), [[], [], [], []]
        for _, _, a in parts(rows_of(docs_, "text")):
            w = a.words
            at = a.long_at[shared.find(a.windows(a.long_at)) >= 0]
            gone = cover(len(w), at, at + window)
            keep = cover(len(w.data), w.s[~gone], w.e[~gone] + 1)
            plain = np.where(NOT_SPACE[w.data], w.data, 0x20)[keep].tobytes()
            size = np.concatenate([[0], np.cumsum((w.e - w.s + 1) * ~gone)])[w.first]
            removed = np.concatenate([[0], np.cumsum(gone)])[w.first]
            head = gone & ~np.concatenate([[False], gone[:-1]])
            head[w.first[:-1][w.counts > 0]] = gone[w.first[:-1][w.counts > 0]]
            spans = np.concatenate([[0], np.cumsum(head)])[w.first]
            out[0] += w.counts.tolist()
            out[1] += np.diff(removed).tolist()
            out[2] += [hashlib.sha256(plain[x : max(x, y - 1)]).hexdigest() for x, y in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
            out[3] += np.diff(spans).tolist()
        return pa.table([ids, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], ["doc_id", "n_words", "n_removed", "kept_sha256", "n_spans"])

    anchors = shared_keys(blocks.groupBy("block").applyInArrow(first, SENT))
    windows = shared_keys(with_block(blocks, anchors, second, SENT))
    return with_block(blocks, windows, last, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long")


def op4_difference_cover(spark, sf_dir: str) -> DataFrame:
    return repeated_windows(table(spark, sf_dir, "documents")).drop("n_spans")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY v) AS n FROM p) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
k AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
j AS (SELECT k.doc_id, string_agg(x, ' ' ORDER BY k.i) FILTER (gone.i IS NULL) AS kept, count(gone.i) AS n_removed FROM k LEFT JOIN gone ON k.doc_id = gone.doc_id AND k.i = gone.i GROUP BY k.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN j USING (doc_id)
"""
