"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark window is a set of word shingles. A document window contains it only if it contains all its shingles,
so with containment 1 the necessary prefix in any fixed order is one shingle; the order is by rarity in the corpus,
counted over all documents. One pass looks up those prefix shingles, bounds each candidate by position and length
(the window must fit into the document's words around the shingle), and verifies it word by word.

The benchmark is broadcast in blocks of some BLOCK_WORDS words, which take about 500 bytes a word on the driver and in each
worker. A larger benchmark costs a pass over the texts for each block: a pass keeps only bitmaps of the documents that
its block hits, and the bitmaps of a document meet at the end.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._bpe import ragged
from quillspark.llm._bytes import ALNUM, HashIndex, Running, Words, cover, pieces, rows_of
from quillspark.llm._spark import filtered, slim, stored, table

WINDOW, SHINGLE, BLOCK_WORDS = 10, 3, 100_000


class Windows:
    """Distinct windows of a block of items: word hashes (zeros beyond the length), and the items of each."""

    def __init__(self, ids: list, texts: list[str], window: int = WINDOW, shingle: int = SHINGLE):
        words = Words(pa.array(texts, pa.string()), ALNUM, lowered=True)
        n = words.counts
        room = words.room()
        size = np.minimum(np.repeat(n, n), window)
        at = np.flatnonzero(room >= size)
        item = words.text_of()[at]
        size = size[at]
        table_ = np.zeros((len(at), window), dtype=np.uint64)
        for k in range(window):
            inside = k < size
            table_[inside, k] = words.h[at[inside] + k]
        whole = Running(words.h).slices(at, at + size)
        _, one, same = np.unique(whole, return_index=True, return_inverse=True)
        self.words, self.size = table_[one], size[one]
        order = np.argsort(same, kind="stable")
        self.items, self.item_at = np.array([str(i) if i is not None else "null" for i in ids], dtype=object)[item[order]], np.searchsorted(same[order], np.arange(len(one) + 1))
        self.q = np.minimum(self.size, shingle)
        seq = Running(self.words.ravel())
        width = window
        owner, offset = [], []
        for k in range(window):
            w = np.flatnonzero(k + self.q <= self.size)
            owner.append(w)
            offset.append(np.full(len(w), k))
        self.owner, self.offset = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (owner, offset))
        base = self.owner * width + self.offset
        self.tokens = seq.slices(base, base + self.q[self.owner])
        self.lengths = sorted(set(self.q.tolist()))
        self.index = HashIndex(np.unique(self.tokens))

    def prefix(self, count: np.ndarray) -> None:
        """Keep for each window its rarest shingle; ties go to the smaller hash, then the first position."""
        token = self.index.find(self.tokens)
        order = np.lexsort((self.offset, token, count[token], self.owner))
        head = np.ones(len(order), dtype=bool)
        head[1:] = self.owner[order][1:] != self.owner[order][:-1]
        pick = order[head]
        pick = pick[np.argsort(token[pick], kind="stable")]
        self.of_token = np.searchsorted(token[pick], np.arange(len(self.index.keys) + 1))
        self.pick_window, self.pick_offset = self.owner[pick], self.offset[pick]

    def shingles_in(self, words: Words):
        """(token, position) of every shingle of the texts that some window has."""
        seq, room = Running(words.h), words.room()
        for q in self.lengths:
            at = np.flatnonzero(room >= q)
            token = self.index.find(seq.slices(at, at + q))
            hit = token >= 0
            yield token[hit], at[hit]

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of all windows that occur in the texts."""
        found = []
        room, text = words.room(), words.text_of()
        for token, at in self.shingles_in(words):
            n = self.of_token[token + 1] - self.of_token[token]
            row = ragged(self.of_token[token], n)
            window, start = self.pick_window[row], np.repeat(at, n) - self.pick_offset[row]
            fits = start >= words.first[text[np.repeat(at, n)]]
            window, start = window[fits], start[fits]
            fits = room[start] >= self.size[window]
            window, start = window[fits], start[fits]
            for k in range(self.words.shape[1]):
                short = self.size[window] <= k
                same = words.h[np.minimum(start + k, len(words) - 1)] == self.words[window, k]
                good = short | same
                window, start = window[good], start[good]
            found.append((window, start))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _blocks(items: DataFrame, item_id: str, text: str, most: int):
    """Item blocks of at most about `most` words, one at a time on the driver."""
    items = items.select(items[item_id].alias("item_id"), F.coalesce(items[text].cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-size // (4 * most)))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow()
        yield rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), n


def _counts(docs: DataFrame, sent) -> np.ndarray:
    """How often each shingle of the windows occurs, over all documents."""

    def count(batches):
        w = sent.value
        total = np.zeros(len(w.index.keys), dtype=np.int64)
        for batch in batches:
            text = rows_of(batch, "text")
            for i, j in pieces(text):
                for token, _ in w.shingles_in(Words(text.slice(i, j - i), ALNUM, lowered=True)):
                    total += np.bincount(token, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["token", "n"])

    out = np.zeros(len(sent.value.index.keys), dtype=np.int64)
    found = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("token").to_numpy()] = found.column("n").to_numpy()
    return out


MARKED = "doc_id long, row long, hits binary, items array<string>"


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted ids as strings).

    A word of a document is hit if it lies in an occurrence of `window` consecutive words of an item, or of all words
    of an item that has fewer. Null texts have no words; items without words are never found; a null item id counts as
    the id `null`. Repeated rows and ids give a row each. Empty tables are fine on either side.
    """
    docs = slim(docs, doc_id, text).withColumn("row", F.lit(0).cast("long"))
    spark = docs.sparkSession
    passes = []
    for ids, texts, n in _blocks(items, item_id, item_text, block_words):
        if n > 1 and not passes:
            # rows get a number that is the same in each pass
            docs = stored(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
        block = Windows(ids, texts, window)
        sent = spark.sparkContext.broadcast(block)
        block.prefix(_counts(docs, sent))
        sent.unpersist()
        marked = docs.mapInArrow(_marker(spark.sparkContext.broadcast(block), len(passes) == n - 1), MARKED)
        passes.append(marked if n == 1 else stored(marked, "marked"))
    if len(passes) > 1:
        marked = reduce(DataFrame.unionAll, passes).groupBy("doc_id", "row").agg(F.collect_list("hits").alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
    else:
        marked = passes[0].withColumn("hits", F.array("hits"))
    empty = hashlib.sha256(b"").hexdigest()

    def finish(batches):
        for batch in batches:
            hits, found = rows_of(batch, "hits").to_pylist(), rows_of(batch, "items").to_pylist()
            n, k = [], []
            for parts in hits:
                # the number of words, then a bitmap of those that are hit, if there are any
                marks = [np.frombuffer(h[8:], np.uint8) for h in parts if len(h) > 8]
                n.append(int.from_bytes(parts[0][:8], "little"))
                k.append(int(np.bitwise_count(np.bitwise_or.reduce(marks)).sum()) if marks else 0)
            sets = [sorted(set(x)) if x else [] for x in found]
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() if x else empty for x in sets]
            yield pa.RecordBatch.from_arrays(
                [rows_of(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(digest, pa.string()), pa.array([x > 0 for x in k], pa.bool_()), pa.array(sets, pa.list_(pa.string()))],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
            )

    return marked.select("doc_id", "hits", "items").mapInArrow(finish, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")


def clean_rows(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of `docs`, all columns, in which no window of an item occurs; a block of items at a time, no shuffle."""
    spark = docs.sparkSession
    words = docs.select(F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    for ids, texts, _ in _blocks(items, item_id, item_text, block_words):
        block = Windows(ids, texts, window)
        block.prefix(_counts(words, spark.sparkContext.broadcast(block)))
        docs = filtered(docs, text, _keeper(spark.sparkContext.broadcast(block)))
    return docs


def _keeper(sent):
    def keep(batches, text):
        for batch in batches:
            column = pc.fill_null(rows_of(batch, text), "")
            for i, j in pieces(column):
                words = Words(column.slice(i, j - i), ALNUM, lowered=True)
                _, start = sent.value.occurrences(words)
                good = np.ones(j - i, dtype=bool)
                good[words.text_of()[start]] = False
                yield batch.slice(i, j - i).filter(pa.array(good))

    return keep


def _marker(sent, every: bool):
    """What one block hits: rows with the number of words and a bitmap, of all documents or of those that it hits."""

    def mark(batches):
        w = sent.value
        for batch in batches:
            text, ids, rows = (rows_of(batch, c) for c in ("text", "doc_id", "row"))
            for i, j in pieces(text):
                words = Words(text.slice(i, j - i), ALNUM, lowered=True)
                window, start = w.occurrences(words)
                hit = cover(len(words), start, start + w.size[window]) if len(window) else np.zeros(len(words), dtype=bool)
                owner = words.text_of()[start]
                sets: dict[int, set] = {}
                for d, x in set(zip(owner.tolist(), window.tolist(), strict=True)):
                    sets.setdefault(d, set()).update(w.items[w.item_at[x] : w.item_at[x + 1]])
                some = range(j - i) if every else sorted(sets)
                bits = [int(words.counts[d]).to_bytes(8, "little") + (np.packbits(hit[words.first[d] : words.first[d + 1]]).tobytes() if d in sets else b"") for d in some]
                at = pa.array(list(some), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).take(at), rows.slice(i, j - i).take(at), pa.array(bits, pa.binary()), pa.array([sorted(sets.get(d, ())) for d in some], pa.list_(pa.string()))], ["doc_id", "row", "hits", "items"])

    return mark


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, least(len(w), 10) AS n, unnest([w[i:i + least(len(w), 10) - 1] for i in range(1, greatest(len(w) - 9, 1) + 1)]) AS v FROM bw WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, w[i:i + n - 1] AS v FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes)),
hit AS (SELECT DISTINCT pos.doc_id, pos.i, pos.n, item_id FROM pos JOIN win ON pos.v = win.v),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
