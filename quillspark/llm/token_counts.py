"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of frequent pre-tokens and their lengths in tokens, built from a bounded sample of the
texts; tier two is a cache in each Python worker, filled by the library for what the table misses. Neither changes a
result, both only save calls of the library. No pre-token is shuffled: the count is one pass over the texts.
"""

from __future__ import annotations

import pickle

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm import _bpe
from quillspark.llm._bytes import pieces, rows_of
from quillspark.llm._spark import slim, table, text_bytes

#: Bytes of text sampled for the table of frequent pre-tokens, and entries of that table (about 30 bytes each).
SAMPLE_BYTES, TABLE_ENTRIES = 24 << 20, 1 << 18
PATH = public_tokenizers.path("byte_bpe_50k.json")


def frequent_pieces(docs: DataFrame, path: str = PATH, sample_bytes: int = SAMPLE_BYTES, entries: int = TABLE_ENTRIES, total: int | None = None) -> _bpe.PieceTable:
    """The most frequent pre-tokens of a sample of slim documents with their ids; it has at most `entries` rows. total: bytes of all texts, where known."""
    total = text_bytes(docs) if total is None else total
    specials = _bpe.added(path)

    def count(batches):
        seen: dict[bytes, int] = {}
        for batch in batches:
            text = rows_of(batch, "text")
            for i, j in pieces(text):
                p = _bpe.Pieces(text.slice(i, j - i), specials)
                _, one, n = np.unique(p.h, return_index=True, return_counts=True)
                for w, k in zip(_bpe.strings(p.data, p.s[one], p.e[one]), n.tolist(), strict=True):
                    seen[w] = seen.get(w, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["w", "n"])

    some = docs if total <= sample_bytes else docs.sample(sample_bytes / total, seed=7)
    top = some.select("text").mapInArrow(count, "w string, n long").groupBy("w").sum("n").where("sum(n) > 1").orderBy("sum(n)", ascending=False).limit(entries)
    column = top.select("w").toArrow().column("w").combine_chunks()
    off, ids = _bpe.encoded(path, column.to_pylist())
    p = _bpe.text_buffer(column)
    s, e = p[0][:-1], p[0][1:]
    return _bpe.PieceTable(_bpe.bytes_hash(p[1]).slices(s, e), _bpe.lead_bytes(p[1], s, e), e - s, off, ids)


def shipped(spark, made: _bpe.PieceTable, path: str):
    """A function that returns the worker's encoder with the broadcast table."""
    sent = spark.sparkContext.broadcast(pickle.dumps(made))
    kept: dict = {}

    def encoder() -> _bpe.Encoder:
        if "it" not in kept:
            kept["it"] = _bpe.Encoder(path, pickle.loads(sent.value))
        return kept["it"]

    return encoder


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 512, path: str = PATH) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty and have 0 tokens. Strings of added tokens inside a text become those tokens, as the
    library does by default. Repeated rows and ids give a row each; no rows give no rows.
    """
    docs = slim(docs, doc_id, text)
    encoder = shipped(docs.sparkSession, frequent_pieces(docs, path), path)

    def count(batches):
        for batch in batches:
            column, ids = rows_of(batch, "text"), rows_of(batch, "doc_id")
            for i, j in pieces(column, _bpe.PIECE_BYTES):
                part = column.slice(i, j - i)
                n = encoder().counts(part)
                size = np.diff(_bpe.text_buffer(part)[0])
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(size), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
