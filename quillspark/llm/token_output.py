"""Token-id output compressed by Re-Pair grammars.

Documents are range-partitioned by doc_id (or taken in the order that they have), encoded, and cut into frames of some
2**18 ids. In each frame, rounds of Re-Pair count all pairs of neighbouring symbols exactly and replace the frequent
ones by new symbols, the more frequent first where they overlap, until no pair is frequent enough. A frame stores its
rules, the number of ids each rule expands to, and the remaining symbols in 16 bits, or in 32 where 16 are too few, so
that the ids at any position are found by a search in the running sum of expansion lengths and a local expansion.
Frames are rows of Parquet files; positions of documents across files follow from the ids of each partition.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm import _bpe
from quillspark.llm._bpe import ragged
from quillspark.llm._bytes import pieces, rows_of
from quillspark.llm._spark import slim, stored, table, text_bytes
from quillspark.llm.token_counts import PATH, frequent_pieces, shipped

#: Ids of a frame before compression (a longer document has a frame of its own).
FRAME_IDS = 1 << 18
#: A pair becomes a rule if it is replaced at least so often: a rule costs four bytes and its expansion length, each use
#: saves two.
LEAST_USES = 4
FRAMES = "part int, before long, n_ids long, base int, width int, left binary, right binary, spans binary, symbols binary, doc_ids array<long>, doc_lens array<long>"


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, left, right): symbol base + r stands for symbols left[r], right[r], which come before it.

    No pair of symbols is left that has LEAST_USES places which do not overlap each other. A pair that is not frequent
    never becomes so, hence a round looks at places that hold a new symbol or were frequent in the round before.
    """
    seq, rules, n_rules = ids.astype(np.int32), [np.zeros(0, np.int64)], 0
    at = np.arange(max(len(seq) - 1, 0), dtype=np.int32)
    while True:
        pair = (seq[at].astype(np.int64) << 32) | seq[at + 1]
        twin = (pair >> 32) == (pair & 0xFFFFFFFF)
        twins, single = at[twin], ~twin
        single[twin] = np.isin(twins, every_other(twins), assume_unique=True)
        at, pair = at[single], pair[single]
        order = np.argsort(pair)
        ranked = pair[order]
        head = np.flatnonzero(np.diff(ranked, prepend=-1))
        count = np.diff(np.append(head, len(ranked)))
        some = np.flatnonzero(count >= LEAST_USES)
        if not len(some):
            break
        some = some[np.argsort(-count[some], kind="stable")]
        keys, places = ranked[head[some]], at[order[ragged(head[some], count[some])]]
        # the places of the round after: those that are frequent now, and beside new symbols; and all twins
        rule = np.full(len(seq), -1, dtype=np.int32)
        rule[places] = np.repeat(np.arange(len(some), dtype=np.int32), count[some])
        look = rule >= 0
        look[twins] = True
        at = _apart(rule)
        rule = rule[at]
        good = np.bincount(rule, minlength=len(keys)) >= LEAST_USES
        good[0] = True  # no place of the most frequent pair was given away
        number, keep = np.cumsum(good, dtype=np.int32) - 1, good[rule]
        at, rule, keys = at[keep], number[rule[keep]], keys[good]
        seq[at] = base + n_rules + rule
        look[at] = look[np.maximum(at - 1, 0)] = True
        rest = np.ones(len(seq), dtype=bool)
        rest[at + 1] = False
        # a place whose second symbol goes had a pair that is gone, and one before a new symbol is looked at
        before = np.flatnonzero(rest)
        seq, look = seq[before], look[before]
        at = np.flatnonzero(look[:-1]).astype(np.int32)
        rules.append(keys)
        n_rules += len(keys)
    pairs = np.concatenate(rules)
    return seq, (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)


def _apart(rule: np.ndarray) -> np.ndarray:
    """Of the places with a rule those of which no two are neighbours: the smaller rule stays, then the first place."""
    at = np.flatnonzero(rule >= 0)
    rank, kept = rule[at].astype(np.int64) * len(rule) + at, [np.zeros(0, np.int64)]
    while len(at):
        near = at[1:] == at[:-1] + 1
        wins = np.ones(len(at), dtype=bool)
        wins[1:] &= ~near | (rank[1:] < rank[:-1])
        wins[:-1] &= ~near | (rank[:-1] < rank[1:])
        kept.append(at[wins])
        open_ = ~wins
        open_[1:] &= ~(near & wins[:-1])
        open_[:-1] &= ~(near & wins[1:])
        at, rank = at[open_], rank[open_]
    return np.sort(np.concatenate(kept))


def every_other(at: np.ndarray) -> np.ndarray:
    """Of each row of consecutive positions, the first, third, fifth .."""
    head = np.ones(len(at), dtype=bool)
    head[1:] = at[1:] != at[:-1] + 1
    first = at[head][np.cumsum(head) - 1]
    return at[(at - first) % 2 == 0]


def spans_of(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule expands to."""
    out = np.ones(base + len(left), dtype=np.int64)
    todo = np.arange(len(left))
    out[base:] = 0
    while len(todo):
        a, b = out[left[todo]], out[right[todo]]
        ready = (a > 0) & (b > 0)
        out[base + todo[ready]] = a[ready] + b[ready]
        todo = todo[~ready]
    return out[base:]


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """The ids of some symbols. Where they are more than the rules, rules are opened once and their ids gathered."""
    if len(symbols) <= len(left) or not len(left):
        return _opened(symbols, left, right, base)
    spans = spans_of(left, right, base)
    pool = np.concatenate([np.arange(base, dtype=np.int32), _opened(np.arange(base, base + len(left)), left, right, base)])
    n = np.concatenate([np.ones(base, np.int64), spans])
    at = np.cumsum(n) - n
    return pool[ragged(at[symbols], n[symbols])]


def _opened(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """All symbols from base on are opened, in rounds, until none is left."""
    seq = symbols.astype(np.int32)
    while True:
        open_ = seq >= base
        if not open_.any():
            return seq
        n = 1 + open_.astype(np.int64)
        where = np.cumsum(n) - n
        out = np.empty(int(n.sum()), dtype=np.int32)
        out[where] = np.where(open_, left[np.where(open_, seq - base, 0)] if len(left) else seq, seq)
        out[where[open_] + 1] = right[seq[open_] - base]
        seq = out


def _numbers(frame: dict, name: str) -> np.ndarray:
    return np.frombuffer(frame[name], f"<u{frame['width']}").astype(np.int32)


def ids_between(frame: dict, start: int, stop: int) -> np.ndarray:
    """Ids start .. stop - 1 of a frame without expanding the rest."""
    base = frame["base"]
    left, right, symbols = (_numbers(frame, c) for c in ("left", "right", "symbols"))
    spans = np.concatenate([np.ones(base, np.int64), np.frombuffer(frame["spans"], "<u4").astype(np.int64)])
    ends = np.cumsum(spans[symbols])
    a = int(np.searchsorted(ends, start, side="right"))
    b = int(np.searchsorted(ends, stop, side="left")) + 1
    skip = start - (int(ends[a - 1]) if a else 0)
    return expand(symbols[a:b], left, right, base)[skip : skip + stop - start]


def packed(ids: np.ndarray, base: int) -> dict:
    """A frame's grammar as stored: width (bytes of a symbol), left, right, spans, symbols."""
    symbols, left, right = compress(ids, base)
    width = 2 if base + len(left) <= 1 << 16 else 4
    spans = spans_of(left, right, base)
    return {"base": base, "width": width, **{k: v.astype(f"<u{width}").tobytes() for k, v in (("left", left), ("right", right), ("symbols", symbols))}, "spans": spans.astype("<u4").tobytes()}


def write_frames(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = PATH, end_id: int = 0, by_id: bool = True) -> DataFrame:
    """The stored frames of all documents, each document's ids followed by end_id.

    Documents are written in ascending doc_id, or, without by_id, in the order that the rows and partitions of `docs`
    have, without a shuffle. Null texts count as empty and have the end id alone; by id, a null doc_id comes first and
    rows that repeat an id lie side by side, ordered by their texts. No rows give no frames.
    """
    docs = slim(docs, doc_id, text)
    spark = docs.sparkSession
    total = text_bytes(docs)
    encoder = shipped(spark, frequent_pieces(docs, path, total=total), path)
    base = _bpe.tokenizer(path).get_vocab_size(with_added_tokens=True)
    names = [c.split()[0] for c in FRAMES.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4, *[pa.list_(pa.int64())] * 2]

    def frame(before: int, parts: list):
        ids = np.concatenate([p[0] for p in parts])
        row = {"part": TaskContext.get().partitionId(), "before": before, "n_ids": len(ids), **packed(ids, base), "doc_ids": [i for p in parts for i in p[1]], "doc_lens": [n for p in parts for n in p[2]]}
        return pa.RecordBatch.from_arrays([pa.array([row[c]], k) for c, k in zip(names, kinds, strict=True)], names)

    def encode(batches):
        before, parts, held = 0, [], 0
        for batch in batches:
            column, known = rows_of(batch, "text"), rows_of(batch, "doc_id")
            for i, j in pieces(column, _bpe.PIECE_BYTES // 2):
                n, flat = encoder().ids(column.slice(i, j - i))
                flat = np.insert(flat, np.cumsum(n), end_id)
                parts.append((flat, known.slice(i, j - i).to_pylist(), (n + 1).tolist()))
                held += len(flat)
                if held >= FRAME_IDS:
                    yield frame(before, parts)
                    before, parts, held = before + held, [], 0
        if parts:
            yield frame(before, parts)

    if by_id:
        n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 26)
        docs = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    frames = docs.mapInArrow(encode, FRAMES)
    return stored(frames, "token-frames")


def read_documents(frames: DataFrame) -> DataFrame:
    """One row per document, decoded from the frames: doc_id, start, n_tokens, ids_crc32."""
    # a frame knows the ids before it in its partition; one row a partition adds those of earlier partitions
    sizes = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", earlier.alias("earlier"))

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                left, right, symbols = (_numbers(row, c) for c in ("left", "right", "symbols"))
                raw = expand(symbols, left, right, row["base"]).astype("<u4").tobytes()
                lens = np.array(row["doc_lens"], dtype=np.int64)
                ends = np.cumsum(lens)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lens).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["earlier"] + row["before"] + ends - lens), pa.array(lens), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return frames.join(starts, "part").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_output(spark, sf_dir: str) -> DataFrame:
    return read_documents(write_frames(table(spark, sf_dir, "documents")))
