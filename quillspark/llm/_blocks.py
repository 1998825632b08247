"""Documents in blocks, and keys that more than one place of the corpus has.

A block is some megabytes of an input split. Blocks are written once as a table bucketed by block, whose numbers
are chosen so that Spark's own bucket hash leaves each block in the task that read it: no text is shuffled, and every
later step meets its blocks without an exchange. Each block sends every key once (with a mark if it has it twice), so
a key that a third of all texts hold reaches its bucket once a block, and what a bucket finds goes back to blocks, not
to single texts. Rows are blobs of sorted 64-bit keys.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._bytes import pieces, rows_of, text_buffer
from quillspark.llm._spark import new_path

#: Most bytes of text of a block (or one text) in a corpus of up to BASE_SPLITS input splits, and in the largest; between them
#: blocks grow with the square root of the splits, so that rows from blocks to buckets grow no faster than the corpus.
BLOCK_BYTES, LARGEST_BLOCK, BASE_SPLITS = 8 << 20, 64 << 20, 1000
#: Keys of a bucket on average, and keys of a row from a block to a bucket.
BUCKET_KEYS, ROW_KEYS = 1 << 20, 64
#: Buckets grow by this factor at most to keep rows of ROW_KEYS keys in very large corpora.
WIDEST = 4
#: Limit of Spark on the buckets of a table.
MOST_FILES = 100_000

#: glibc's call that gives free memory back; other C libraries may lack it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

SENT = "bucket int, block int, keys binary, twice binary"
BACK = "block int, keys binary"


@dataclass
class Blocks:
    """docs: (block, doc_id, text); bytes of all texts; number of blocks."""

    docs: DataFrame
    bytes: int
    n: int

    def buckets(self, n_keys: int) -> int:
        return max(4, -(-n_keys // min(max(BUCKET_KEYS, ROW_KEYS * self.n), WIDEST * BUCKET_KEYS)))


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash of ints (Murmur3, seed 42), which deals rows to buckets."""

    def turned(v, r):
        return (v << np.uint32(r)) | (v >> np.uint32(32 - r))

    k = turned(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turned(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h = h ^ np.uint32(4)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def _numbers(part: int, n: int):
    """Block numbers that fall to bucket part % n, different for each part."""
    at = (part // n) << 24
    while True:
        x = np.arange(at, at + 64 * n, dtype=np.int64).astype(np.int32)
        yield from x[spark_hash(x).astype(np.int64) % n == part % n].tolist()
        at += 64 * n


def in_blocks(docs: DataFrame) -> Blocks:
    """Slim documents in blocks, written once."""
    spark = docs.sparkSession
    splits = docs.rdd.getNumPartitions()
    n = max(1, min(splits, MOST_FILES))
    most = int(min(LARGEST_BLOCK, BLOCK_BYTES * max(1.0, (splits / BASE_SPLITS) ** 0.5)))

    def cut(batches):
        numbers = _numbers(TaskContext.get().partitionId(), n)
        block, held = next(numbers), 0
        for batch in batches:
            text, ids = rows_of(batch, "text"), rows_of(batch, "doc_id")
            for i, j in pieces(text, most):
                size = np.diff(text_buffer(text.slice(i, j - i))[0])
                if held and held + int(size.sum()) > most:
                    block, held = next(numbers), 0
                held += int(size.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, block, np.int32)), ids.slice(i, j - i), text.slice(i, j - i), pa.array(size)], ["block", "doc_id", "text", "size"])

    name = f"quillspark_{uuid.uuid4().hex}"
    cut_ = docs.select("doc_id", "text").mapInArrow(cut, "block int, doc_id long, text string, size long")
    cut_.write.format("parquet").option("path", new_path(spark, "blocks")).bucketBy(n, "block").saveAsTable(name)
    out = spark.table(name)
    r = out.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_distinct("block").alias("n")).first()
    return Blocks(out.select("block", "doc_id", "text"), r["bytes"], max(1, r["n"]))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """By leading bits, so that sorted keys fall to buckets in order."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def spans(at: np.ndarray):
    """(value, from, to) of each run of equal values."""
    head = np.flatnonzero(np.diff(at, prepend=at[:1] - 1))
    yield from zip(at[head].tolist(), head.tolist(), np.append(head[1:], len(at))[: len(head)].tolist(), strict=True)


def split_keys(keys: np.ndarray, n: int):
    """(bucket, from, to) of sorted keys."""
    return spans(bucket_of(keys, n))


def number(table: pa.Table, name: str) -> int:
    return rows_of(table, name)[0].as_py()


def send(block: int, keys: np.ndarray, n: int) -> pa.Table:
    """All keys of a block (repeats allowed) for their buckets."""
    keys, count = np.unique(keys, return_counts=True)
    rows = [(b, block, keys[i:j].tobytes(), np.packbits(count[i:j] > 1).tobytes()) for b, i, j in split_keys(keys, n)]
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["bucket", "block", "keys", "twice"])


def _meet(table: pa.Table) -> pa.Table:
    """What a bucket sends back: to each block those of its keys that occur elsewhere or twice in it."""
    blocks = rows_of(table, "block").to_pylist()
    parts = [np.frombuffer(x, np.uint64) for x in rows_of(table, "keys").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(rows_of(table, "twice").to_pylist(), parts, strict=True)]
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.concatenate([[False], ranked[1:] == ranked[:-1], [False]])
    shared = np.empty(len(keys), dtype=bool)
    shared[order] = same[1:] | same[:-1]
    shared |= np.concatenate(twice)
    out, i = [], 0
    for b, k in zip(blocks, parts, strict=True):
        mine = k[shared[i : i + len(k)]]
        i += len(k)
        if len(mine):
            out.append((b, mine.tobytes()))
    return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["block", "keys"])


def shared_keys(sent: DataFrame) -> DataFrame:
    """(block, keys): of what blocks sent, the keys that occur more than once in the corpus."""
    return sent.groupBy("bucket").applyInArrow(slimmed(_meet), BACK)


def joined_keys(table: pa.Table) -> np.ndarray:
    """All keys sent back to a block, sorted."""
    parts = [np.frombuffer(x, np.uint64) for x in rows_of(table, "keys").to_pylist()] if table.num_rows else []
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def released(out: pa.Table) -> pa.Table:
    """out, after what its making has left free went back to the system: Python workers that wait for a next group stay small."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
    return out


def slimmed(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """f for groups, with memory released after each."""

    def one(table: pa.Table) -> pa.Table:
        return released(f(table))

    return one


def with_block(docs: DataFrame, back: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """f on each block's documents and on what came back to it; blocks without documents give nothing."""

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        return released(f(a, b))

    return docs.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(both, schema)
