"""Toxicity by gradient-boosted trees over dense text features, with isotonic calibration.

Labelled rows, TRAIN_ROWS at most, fall into parts by a hash of their id. A lexicon of words and word beginnings that
are far more frequent in toxic texts is learned from all of them; for the features of a training row, from other parts
only, so that the trees see how far the lexicon carries over. One part calibrates. The features are densities of lexicon words, of words that a spelling with digits or signs hides, their proximity to the
second person, capitals, punctuation and obfuscation rates. Scoring is one pass over the texts with a small broadcast
model.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._bytes import HashIndex, Words, bytes_hash, pieces, rows_of, separated
from quillspark.llm._spark import filtered, slim, stored, table

#: Most labelled rows used.
TRAIN_ROWS = 16_000
#: Lexicon entries kept, the least number of toxic texts and log-odds of an entry, and -log of how likely chance may be
#: to put it into so many toxic texts (some thousand words are tried).
LEXICON, LEAST_TEXTS, LEAST_ODDS, CHANCE = 4000, 4, 2.5, 7.0
#: Byte lengths of word beginnings, and the words between a lexicon word and a second person that count as near.
STEMS, NEAR = (4, 5, 6), 5
ROUNDS, DEPTH, RATE, BINS = 60, 3, 0.2, 48
THRESHOLD = 0.7

# Words of the second person, and signs that stand for letters
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie", "tu", "te", "toi", "ton", "ta", "vous", "votre", "tú", "usted", "ustedes", "vosotros", "ti"]
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

FEATURES = ["log_words", "lex_density", "lex_hits", "lex_odds", "lex_best", "stem_density", "stem_hits", "stem_best", "hidden_density", "hidden_hits", "near_second", "second_density", "capitals", "capital_words", "exclaim", "question", "punct_runs", "mixed_words", "letter_runs", "digits"]

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100), ord("@"), ord("$"), ord("*")]] = True
_SALT = np.uint64(0x9FB21C651E98DF25)


def _hash(words: list[str]) -> np.ndarray:
    """Hashes of whole words, as Words has them."""
    out = [Words(pa.array([w], pa.string()), _WORD, lowered=True).h for w in words]
    return np.array([h[0] if len(h) else 0 for h in out], dtype=np.uint64)


def _stems(w: Words):
    """(word, hash) for each beginning of a longer word, cut at whole characters."""
    run = bytes_hash(w.data)
    pad = np.append(w.data, 0)
    for k in STEMS:
        at = np.flatnonzero(w.e - w.s > k)
        at = at[(pad[w.s[at] + k] & 0xC0) != 0x80]
        yield at, run.slices(w.s[at], w.s[at] + k) ^ (_SALT + np.uint64(k))


_UNLEET = np.arange(256, dtype=np.uint8)
for _a, _b in LEET.items():
    _UNLEET[ord(_a)] = ord(_b)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])[first])


def _most(at: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    np.maximum.at(out, at, value)
    return out


class Lexicon:
    """Hashes of words and word beginnings with their log-odds, and of the second person."""

    def __init__(self, words: dict[int, float], stems: dict[int, float]):
        for name, found in (("word", words), ("stem", stems)):
            keys = np.array(sorted(found), dtype=np.uint64)
            setattr(self, name, HashIndex(keys))
            setattr(self, f"{name}_odds", np.array([found[int(k)] for k in keys], dtype=np.float64))
        self.second = HashIndex(np.unique(_hash(SECOND_PERSON)))

    def features(self, column: pa.Array) -> np.ndarray:
        """One row of FEATURES for each text; an empty text has zeros."""
        n = len(column)
        w = Words(column, _WORD, lowered=True)
        raw, starts = separated(column)
        per = np.maximum(w.counts, 1).astype(np.float64)
        text = w.text_of()
        row = self.word.find(w.h)
        lex = row >= 0
        odds = np.where(lex, self.word_odds[row] if len(self.word_odds) else 0.0, 0.0)
        best = np.zeros(len(w))
        for at, h in _stems(w):
            r = self.stem.find(h)
            hit = r >= 0
            best[at[hit]] = np.maximum(best[at[hit]], self.stem_odds[r[hit]])
        stem = best > 0
        # words with digits or signs inside, read as letters
        odd_byte = np.concatenate([[0], np.cumsum((w.data < 0x61) & _WORD[w.data])])
        letters = np.concatenate([[0], np.cumsum(w.data >= 0x61)])
        mixed = (odd_byte[w.e] > odd_byte[w.s]) & (letters[w.e] > letters[w.s])
        hidden = np.zeros(len(w), dtype=bool)
        at = np.flatnonzero(mixed)
        if len(at):
            hidden[at] = self.word.find(bytes_hash(_UNLEET[w.data]).slices(w.s[at], w.e[at])) >= 0
        second = self.second.find(w.h) >= 0
        bad = lex | stem | hidden
        seen = np.concatenate([[0], np.cumsum(second)])
        lo, hi = np.maximum(np.arange(len(w)) - NEAR, w.first[text]), np.minimum(np.arange(len(w)) + NEAR + 1, w.first[text + 1])
        near = bad & (seen[hi] > seen[lo])
        size = np.maximum(np.diff(starts) - 1, 1).astype(np.float64)
        upper = (raw >= 0x41) & (raw < 0x5B)
        alpha = upper | (raw >= 0x61) & (raw < 0x7B) | (raw >= 0xC0)
        caps = np.concatenate([[0], np.cumsum(upper)])
        shout = (caps[w.e] - caps[w.s] == w.e - w.s) & (w.e - w.s > 1)
        mark = (raw == 0x21) | (raw == 0x3F)
        twice = mark[1:] & mark[:-1] if len(raw) > 1 else np.zeros(0, bool)
        thrice = (w.data[2:] == w.data[1:-1]) & (w.data[1:-1] == w.data[:-2]) & (w.data[2:] >= 0x61) if len(raw) > 2 else np.zeros(0, bool)
        pad = lambda x: np.concatenate([x, np.zeros(len(raw) - len(x), bool)])
        by_word, by_byte = (lambda x: _sums(x, w.first)), (lambda x: _sums(x, starts))
        hits, stems, masked = by_word(lex), by_word(stem), by_word(hidden)
        return np.column_stack([
            np.log1p(w.counts), hits / per, hits, by_word(odds) / per, _most(text[lex], odds[lex], n), stems / per, stems, _most(text[stem], best[stem], n), masked / per, masked,
            by_word(near) / per, by_word(second) / per, by_byte(upper) / np.maximum(by_byte(alpha), 1), by_word(shout) / per, by_byte(raw == 0x21) / size, by_byte(raw == 0x3F) / size,
            by_byte(pad(twice)) / size, by_word(mixed) / per, by_byte(pad(thrice)) / size, by_byte((raw >= 0x30) & (raw < 0x3A)) / size,
        ])


def _surprise(a: int, k: int, p: float) -> float:
    """-log of a bound on the chance that a or more of k texts are toxic where a share p is (Chernoff)."""
    x = a / k
    if x <= p:
        return 0.0
    return k * (x * math.log(x / max(p, 1e-9)) + ((1 - x) * math.log((1 - x) / (1 - p)) if x < 1 else 0.0))


#: Parts of the training rows; a row's own fold (part % FOLDS) is left out of the lexicon behind its features.
PARTS, FOLDS = 6, 3


def part_of(doc_id) -> F.Column:
    return F.pmod(F.xxhash64(doc_id.cast("string"), F.lit("part")), F.lit(PARTS)).cast("int")


def learn_lexicons(rows: DataFrame, entries: int = LEXICON) -> list[Lexicon]:
    """Lexicons from rows (text, toxic, part): one without each fold, then one from all rows.

    Candidates come from toxic texts alone, so that clean texts only add to counts of those.
    """

    def tokens(batches):
        """(kind, part, hashes): the distinct words and beginnings of every text."""
        for batch in batches:
            text, part = rows_of(batch, "text"), rows_of(batch, "part").to_numpy(zero_copy_only=False)
            for i, j in pieces(text):
                w = Words(text.slice(i, j - i), _WORD, lowered=True)
                owner = w.text_of()
                for kind, at, h in [(0, np.arange(len(w)), w.h), *((1, a, h) for a, h in _stems(w))]:
                    pair = np.unique(np.column_stack([owner[at].astype(np.uint64), h]), axis=0) if len(at) else np.zeros((0, 2), np.uint64)
                    yield kind, part[i + pair[:, 0].astype(np.int64)], pair[:, 1]

    def packed(found):
        for kind, part, h, n in found:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind), pa.int32()), pa.array(part, pa.int32()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["kind", "part", "h", "n"])

    def toxic(batches):
        held: dict[tuple[int, int], list] = {}
        for kind, part, h in tokens(batches):
            for p in np.unique(part):
                held.setdefault((kind, int(p)), []).append(h[part == p])
        for (kind, p), parts in held.items():
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            yield from packed([(kind, np.full(len(h), p), h, n)])

    shape, spark = "kind int, part int, h long, n long", rows.sparkSession
    sizes = np.zeros((2, PARTS))
    for r in rows.groupBy("toxic", "part").count().collect():
        sizes[r["toxic"], r["part"]] = r["count"]
    seen = rows.where("toxic = 1").select("text", "part").mapInArrow(toxic, shape).groupBy("kind", "h").pivot("part", list(range(PARTS))).agg(F.sum("n")).fillna(0)
    total = sum((F.col(f"`{p}`") for p in range(1, PARTS)), F.col("`0`"))
    top = seen.withColumn("n", total).where(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "kind", "h").limit(50 * entries).toPandas()
    kind, h = top["kind"].to_numpy(dtype=np.int64), top["h"].to_numpy(dtype=np.int64).view(np.uint64)
    bad = top[[str(p) for p in range(PARTS)]].to_numpy(dtype=float).reshape(len(top), PARTS)
    order = {k: np.flatnonzero(kind == k)[np.argsort(h[kind == k])] for k in (0, 1)}
    sent = spark.sparkContext.broadcast({k: HashIndex(h[at]) for k, at in order.items()})

    def clean(batches):
        count = {k: np.zeros((len(x.keys), PARTS), np.int64) for k, x in sent.value.items()}
        for k, part, hashes in tokens(batches):
            row = sent.value[k].find(hashes)
            np.add.at(count[k], (row[row >= 0], part[row >= 0]), 1)
        for k, n in count.items():
            at, p = np.nonzero(n)
            yield from packed([(k, p, at.astype(np.uint64), n[at, p])])

    good = np.zeros((len(top), PARTS))
    also = rows.where("toxic = 0").select("text", "part").mapInArrow(clean, shape).groupBy("kind", "part", "h").agg(F.sum("n").alias("n")).toArrow()
    kinds, parts_, at, n = (also.column(c).to_numpy() for c in ("kind", "part", "h", "n"))
    for k in (0, 1):
        own = kinds == k
        good[order[k][at[own]], parts_[own]] = n[own]
    out = []
    for fold in (*range(FOLDS), None):
        use = np.array([fold is None or p % FOLDS != fold for p in range(PARTS)])
        n_good, n_bad = sizes[0, use].sum(), sizes[1, use].sum()
        a, b = bad[:, use].sum(axis=1), good[:, use].sum(axis=1)
        odds = np.log((a + 0.5) / (n_bad + 1)) - np.log((b + 0.5) / (n_good + 1))
        rank = odds * np.sqrt(a)
        found: tuple[dict, dict] = ({}, {})
        share = n_bad / max(n_bad + n_good, 1)
        fit_ = np.flatnonzero((a >= LEAST_TEXTS) & (odds >= LEAST_ODDS))
        fit_ = [i for i in fit_[np.lexsort((h[fit_], -rank[fit_]))] if _surprise(a[i], a[i] + b[i], share) >= CHANCE]
        for i in fit_[:entries]:
            found[kind[i]][int(h[i])] = float(odds[i])
        out.append(Lexicon(*found))
    return out


class Trees:
    """Boosted trees for the log-odds of a label, on features cut into quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE):
        n, m = x.shape
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for f in range(m)]
        positive = min(max(y.mean() if n else 0.0, 1e-3), 1 - 1e-3)
        self.start, self.depth, self.trees = math.log(positive / (1 - positive)), depth, []
        if n == 0 or y.min() == y.max():
            return
        b = self._bins(x)
        f = np.full(n, self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, BINS, np.int64)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                first, k = 2**level - 1, 2**level
                top = np.full(k, 1e-6)
                for j in range(m):
                    cell = (node - first) * BINS + b[:, j]
                    cg = np.cumsum(np.bincount(cell, g, k * BINS).reshape(k, BINS), axis=1)
                    ch = np.cumsum(np.bincount(cell, h, k * BINS).reshape(k, BINS), axis=1)
                    tg, th = cg[:, -1:], ch[:, -1:]
                    gain = cg**2 / (ch + 1) + (tg - cg) ** 2 / (th - ch + 1) - tg**2 / (th + 1)
                    gain[(ch < 1) | (th - ch < 1)] = 0
                    at = gain.argmax(axis=1)
                    value = gain[np.arange(k), at]
                    better = value > top
                    top = np.where(better, value, top)
                    feature[first : first + k][better], cut[first : first + k][better] = j, at[better]
                node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
            leaf = node - (2**depth - 1)
            value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
            self.trees.append((feature, cut, value))
            f += value[leaf]

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)]) if len(x) else np.zeros(x.shape, np.int64)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, row = self._bins(x), np.arange(len(x))
        out = np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[row, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, probabilities), both ascending: least-squares monotone fit by pooling adjacent violators."""
    order = np.argsort(raw, kind="stable")
    x, at = np.unique(raw[order], return_index=True)
    if not len(x):
        return x, x
    total, n = np.add.reduceat(y[order].astype(float), at), np.diff(np.append(at, len(y))).astype(float)
    pools: list[list[float]] = []
    for s, k, v in zip(total, n, x, strict=True):
        pools.append([s, k, v, v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s2, k2, _, hi = pools.pop()
            pools[-1][0] += s2
            pools[-1][1] += k2
            pools[-1][3] = hi
    # a little weight on both classes keeps the ends off 0 and 1
    p = [((s + 0.25) / (k + 0.5)) for s, k, _, _ in pools]
    p = np.maximum.accumulate(p)
    return np.array([v for _, _, lo, hi in pools for v in (lo, hi)]), np.repeat(p, 2)


class Model:
    def __init__(self, lexicon: Lexicon, trees: Trees, curve: tuple[np.ndarray, np.ndarray]):
        self.lexicon, self.trees, self.curve = lexicon, trees, curve

    def scores(self, column: pa.Array) -> np.ndarray:
        raw = self.trees.raw(self.lexicon.features(column))
        if not len(self.curve[0]):
            return 1 / (1 + np.exp(-raw))
        return np.clip(np.interp(raw, *self.curve), 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """A model from (doc_id, text) and (doc_id, toxic); some `most` labels are used, chosen by a hash of the id.

    Of rows that repeat an id the one of the least text is learned from, so rows are no more than labels. Of labels that
    repeat an id the greatest counts.
    """
    spark = docs.sparkSession
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = min(1.0, most / max(n, 1))
    some = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    # a hash keeps some sqrt(most) more or less than `most` rows of two numbers
    chosen = docs.join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    chosen = stored(chosen.select("doc_id", "text", F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic"), part_of(F.col("doc_id")).alias("part")), "toxic-train")
    lexicons = learn_lexicons(chosen)
    sent = spark.sparkContext.broadcast(lexicons)

    def features(batches):
        for batch in batches:
            text, part = rows_of(batch, "text"), rows_of(batch, "part").to_numpy(zero_copy_only=False)
            for i, j in pieces(text):
                fold = part[i:j] % FOLDS
                x = np.zeros((j - i, len(FEATURES)))
                for k in np.unique(fold):
                    x[fold == k] = sent.value[k].features(text.slice(i, j - i).take(pa.array(np.flatnonzero(fold == k))))
                keep = [rows_of(batch, c).slice(i, j - i) for c in ("doc_id", "toxic", "part")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "toxic", "part", "x"])

    # bounded by `most`: some 20 numbers a row
    got = chosen.mapInArrow(features, "doc_id long, toxic int, part int, x array<double>").orderBy("doc_id").toPandas()
    x, y, part = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(FEATURES)), got["toxic"].to_numpy(dtype=float), got["part"].to_numpy()
    held = part == PARTS - 1
    trees = Trees(x[~held], y[~held])
    return Model(lexicons[-1], trees, isotonic(trees.raw(x[held]), y[held]))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS, held_out=None) -> Model:
    """A model for `docs`. Labels without a document, null labels and null ids are not used, nor ids that held_out marks."""
    known = labels.select(labels[doc_id].cast("long").alias("doc_id"), labels[label].cast("int").alias("toxic"))
    if held_out:
        known = known.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    return train(slim(docs, doc_id, text), known, train_rows)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, held_out=None) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    held_out is a Column function of the id that marks rows never learned from; without it every label may be used.
    Null texts count as empty and get a score too. Without labels of both classes the score is the share of label 1,
    0.001 at least. Repeated rows and ids give a row each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id, text, label, train_rows, held_out))
    docs = slim(docs, doc_id, text)
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False)) if held_out else F.lit(False)

    def score(batches):
        for batch in batches:
            column, ids, held = (rows_of(batch, c) for c in ("text", "doc_id", "held_out"))
            for i, j in pieces(column):
                s = sent.value.scores(column.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), held.slice(i, j - i), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.withColumn("held_out", out).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def clean_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, held_out=None) -> DataFrame:
    """The rows of `docs`, all columns, whose score is below the threshold: one pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id, text, label, train_rows, held_out))

    def keep(batches, name):
        for batch in batches:
            column = pc.fill_null(rows_of(batch, name), "")
            for i, j in pieces(column):
                good = sent.value.scores(column.slice(i, j - i)) < threshold
                yield batch.slice(i, j - i).filter(pa.array(good))

    return filtered(docs, text, keep)


def mod3_is_1(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=mod3_is_1)
