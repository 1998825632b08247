"""Language identification by interpolated Kneser-Ney character models.

For every language, counts of character 4-grams over all its training rows are gathered with partial sums in numpy
blobs. Continuation counts, discounts and the probabilities of all orders follow from those counts. The model is one
sorted array of n-gram hashes for each order, each with a row of log-probabilities (one for each language); what an
order lacks backs off through the weights of its contexts. No count is left out: a model of at most SENT_CELLS numbers is
built on the driver and broadcast; a larger one is built in Spark, stays in Parquet, and blocks of documents fetch the
rows that their n-grams need from hash buckets. A text gets the language of the lowest cross-entropy per
character; it is marked rejected where that entropy is beyond what training rows of the language have under a
model without them.
"""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from quillspark.llm._blocks import number, with_block
from quillspark.llm._bytes import HashIndex, mix, pieces, rows_of
from quillspark.llm._spark import slim, stored, table, text_bytes

ORDER = 4
#: 4-gram counts times languages up to which the model is broadcast; beyond, it is scored by hash buckets.
SENT_CELLS = 1 << 22
#: Bytes of text, and numbers of the model, to a hash bucket on average.
BUCKET_BYTES, BUCKET_CELLS = 32 << 20, 1 << 21
#: Bytes of text of a block that is scored by hash buckets.
BLOCK_BYTES = 6 << 20
#: One training row in so many is kept for calibration; standard deviations from its mean where rejection starts.
CALIBRATE, REJECT_SD = 16, 6.0
_START, _BLANK = 1, 2
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Lower-case letter of each code point; blank for what is no letter."""
    out = np.full(0x110000, _BLANK, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Chars:
    """The letters of some texts, each text after ORDER - 1 start marks; white space and signs are one blank.

    Symbols have 16 bits: a letter beyond them is two symbols, as in UTF-16.
    """

    def __init__(self, column: pa.Array):
        texts = column.to_pylist()
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        code = _letters()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        keep = np.ones(len(code), dtype=bool)
        keep[1:] = (code[1:] != _BLANK) | (code[:-1] != _BLANK)
        keep[starts[sizes > 0]] = True
        kept = np.concatenate([[0], np.cumsum(keep)])
        letter = np.concatenate([[0], np.cumsum(code != _BLANK)])
        self.has_letter = letter[ends] > letter[starts]
        code = code[keep]
        wide = code > 0xFFFF
        at = np.concatenate([[0], np.cumsum(1 + wide)])
        starts, lens = at[kept[starts]], at[kept[ends]] - at[kept[starts]]
        over = code[wide] - 0x10000
        code = np.repeat(code, 1 + wide)
        second = at[1:][wide] - 1
        code[second - 1], code[second] = 0xD800 + (over >> 10), 0xDC00 + (over & 0x3FF)
        code = np.insert(code, np.repeat(starts, ORDER - 1), _START).astype(np.uint64)
        #: Positions of text i: first[i] .. first[i + 1] - 1; its start marks lie before first[i] in `code`.
        self.n = lens
        mark = np.cumsum(lens + ORDER - 1) - lens
        real = np.ones(len(code), dtype=bool)
        for k in range(ORDER - 1):
            real[mark - 1 - k] = False
        self.at = np.flatnonzero(real)
        self.first = np.concatenate([[0], np.cumsum(lens)])
        self.code = code

    def grams(self) -> np.ndarray:
        """The ORDER symbols that end at each position, packed into 64 bits."""
        c, at = self.code, self.at
        return (c[at - 3] << np.uint64(48)) | (c[at - 2] << np.uint64(32)) | (c[at - 1] << np.uint64(16)) | c[at]


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows (lang, text): merged in each task, then summed by gram."""

    def count(batches):
        held: dict[str, list] = {}
        for batch in batches:
            text, lang = rows_of(batch, "text"), np.array(rows_of(batch, "lang").to_pylist(), dtype=object)
            for name in dict.fromkeys(lang):
                own = text.take(pa.array(np.flatnonzero(lang == name)))
                for i, j in pieces(own):
                    merge(held.setdefault(name, [np.zeros(0, np.uint64), np.zeros(0, np.int64), []]), Chars(own.slice(i, j - i)).grams())
        for name, (keys, n, more) in held.items():
            keys, n = merged(keys, n, more)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    def merged(keys, n, more):
        if more:
            keys, at = np.unique(np.concatenate([keys, *(k for k, _ in more)]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, *(c for _, c in more)]), len(keys)).astype(np.int64)
        return keys, n

    def merge(state, grams):
        state[2].append(np.unique(grams, return_counts=True))
        if sum(len(k) for k, _ in state[2]) > 1 << 20:
            state[0], state[1] = merged(*state)
            state[2] = []

    return rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Level:
    """One order: hashes and log-probabilities of its n-grams, hashes and log back-off weights of their contexts."""

    def __init__(self, grams, prob, contexts, weight):
        order = np.argsort(mix(grams))
        self.index, self.prob = HashIndex(mix(grams)[order]), prob[order]
        order = np.argsort(mix(contexts))
        self.contexts, self.weight = HashIndex(mix(contexts)[order]), weight[order]


def _logs(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p, 1e-12)).astype(np.float32)


class Model:
    """counts: for each language, sorted packed 4-grams and their counts."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.levels: list[Level] = []
        self.limit: dict[str, tuple[float, float]] = {}
        if not self.langs:
            return
        # orders from 4 down to 1; below 4, an n-gram counts how many symbols come before it
        tables = []
        for name in self.langs:
            grams, n = counts[name]
            own = [(grams, n.astype(float))]
            for k in range(1, ORDER):
                shorter, n = np.unique(own[-1][0] & np.uint64((1 << (16 * (ORDER - k))) - 1), return_counts=True)
                own.append((shorter, n.astype(float)))
            tables.append(own)
        vocab = len(np.unique(np.concatenate([t[-1][0] for t in tables]))) + 1
        below = below_keys = None
        self.floor = np.log(1.0 / vocab)
        for order in range(1, ORDER + 1):
            parts = [t[ORDER - order] for t in tables]
            keys = np.unique(np.concatenate([p[0] for p in parts]))
            heads = np.unique(keys >> np.uint64(16))
            prob, weight = np.zeros((len(keys), len(parts))), np.ones((len(heads), len(parts)))
            tail = keys & np.uint64((1 << (16 * (order - 1))) - 1)
            for x, (grams, n) in enumerate(parts):
                ones, twos = max((n == 1).sum(), 1), max((n == 2).sum(), 1)
                d = ones / (ones + 2 * twos)
                head, at = np.unique(grams >> np.uint64(16), return_inverse=True)
                total, kinds = np.bincount(at, n), np.bincount(at, minlength=len(head))
                where = np.searchsorted(heads, head)
                weight[where, x] = np.minimum(d * kinds / total, 1.0)
                lower = np.full(len(keys), 1.0 / vocab) if below is None else below[np.searchsorted(below_keys, tail), x]
                prob[:, x] = weight[np.searchsorted(heads, keys >> np.uint64(16)), x] * lower
                prob[np.searchsorted(keys, grams), x] += np.maximum(n - d, 0) / total[at]
            below, below_keys = prob, keys
            self.levels.append(Level(keys, _logs(prob), heads, _logs(weight)))

    @classmethod
    def of(cls, langs: list[str], floor: float, limit: dict, levels: list[Level]) -> Model:
        """A model of given levels, such as those that the texts of a block need."""
        model = cls({})
        model.langs, model.floor, model.limit, model.levels = langs, floor, limit, levels
        return model

    def entropies(self, c: Chars) -> np.ndarray:
        """Cross-entropy per character of each text under each language, in nats."""
        grams, wide = c.grams(), len(self.langs)
        out = np.zeros((len(grams), wide), dtype=np.float32)
        rest = np.arange(len(grams))
        for order in range(ORDER, 0, -1):
            level = self.levels[order - 1]
            key = grams[rest] & np.uint64((1 << (16 * order)) - 1)
            row = level.index.find(mix(key))
            hit = row >= 0
            out[rest[hit]] += level.prob[row[hit]]
            rest, key = rest[~hit], key[~hit]
            if not len(rest):
                break
            head = level.contexts.find(mix(key >> np.uint64(16)))
            known = head >= 0
            out[rest[known]] += level.weight[head[known]]
        out[rest] += self.floor
        total = np.zeros((len(c.n), wide))
        full = np.flatnonzero(c.n)
        if len(full):
            total[full] = np.add.reduceat(out, c.first[full], axis=0, dtype=np.float64)
        return -total / np.maximum(c.n, 1)[:, None]

    def predict(self, column: pa.Array):
        """(language, score, entropy, rejected) of each text."""
        c = Chars(column)
        if not self.langs:
            n = len(column)
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n, dtype=bool)
        e = self.entropies(c)
        best = e.argmin(axis=1)
        low = e[np.arange(len(e)), best]
        # posterior of the languages, a text counting as 40 characters at most
        score = 1 / np.exp((low[:, None] - e) * np.minimum(c.n, 40)[:, None]).sum(axis=1)
        names = np.array(self.langs, dtype=object)[best]
        top = np.array([mean + REJECT_SD * sd for mean, sd in (self.limit.get(x, (np.inf, 0.0)) for x in self.langs)])
        rejected = (low > top[best]) | ~c.has_letter
        names[~c.has_letter] = UNKNOWN
        return names.tolist(), np.where(c.has_letter, score, 0.0), low, rejected


class Tables:
    """A model too large to send: stored rows (level, gram, row) of all orders, a number for each language in a row.

    Levels 0 .. ORDER - 1 hold the probabilities of orders 1 .. ORDER, the next ORDER levels the weights of their
    contexts.
    """

    def __init__(self, counts: DataFrame, langs: list[str], n_counts: int):
        self.langs, self.cells = langs, n_counts * len(langs)
        self.limit: dict[str, tuple[float, float]] = {}
        every = F.sequence(F.lit(0), F.lit(len(langs) - 1))
        at = lambda name, x: F.try_element_at(F.col(name), x)
        by_lang = lambda value: F.map_from_entries(F.collect_list(F.struct("x", value)))
        names = F.array(*[F.lit(x) for x in langs])
        n = counts.select((F.array_position(names, F.col("lang")) - 1).cast("int").alias("x"), "gram", "n")
        parts = [n]
        for k in range(ORDER - 1, 0, -1):
            shorter = F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1))
            parts.insert(0, stored(parts[0].select("x", shorter.alias("gram")).groupBy("x", "gram").agg(F.count("*").alias("n")), "grams"))
        vocab = parts[0].select("gram").distinct().count() + 1
        self.floor = np.log(1.0 / vocab)
        below, out = None, []
        for k, n in enumerate(parts):
            d = [0.0] * len(langs)
            for r in n.groupBy("x").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect():
                d[r["x"]] = max(r["ones"], 1) / (max(r["ones"], 1) + 2 * max(r["twos"], 1))
            d = F.element_at(F.array(*[F.lit(x) for x in d]), F.col("x") + 1)
            n = n.withColumn("head", F.shiftrightunsigned("gram", 16))
            heads = n.groupBy("x", "head").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
            weight = heads.withColumn("w", F.least(d * F.col("kinds") / F.col("total"), F.lit(1.0))).groupBy("head").agg(by_lang("w").alias("m"))
            weight = stored(weight.select("head", F.transform(every, lambda x: F.coalesce(at("m", x), F.lit(1.0))).alias("w")), "gram-weights")
            seen = n.join(heads, ["x", "head"]).withColumn("p", F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total")).groupBy("gram").agg(F.first("head").alias("head"), by_lang("p").alias("m"))
            seen = seen.join(weight, "head")
            if below is None:
                seen = seen.withColumn("lower", F.transform(every, lambda x: F.lit(1.0 / vocab)))
            else:
                tail = F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1))
                seen = seen.withColumn("tail", tail).join(below.select(F.col("gram").alias("tail"), F.col("row").alias("lower")), "tail")
            row = F.transform(every, lambda x: F.coalesce(at("m", x), F.lit(0.0)) + at("w", x + 1) * at("lower", x + 1))
            below = stored(seen.select("gram", row.alias("row")), "gram-probabilities")
            out += [below.select(F.lit(k).alias("level"), "gram", "row"), weight.select(F.lit(ORDER + k).alias("level"), F.col("head").alias("gram"), F.col("w").alias("row"))]
        self.rows = reduce(DataFrame.unionAll, out)


def _wanted(column: pa.Array) -> list[np.ndarray]:
    """For each level of Tables, the n-grams that scoring some texts can ask for."""
    found = [np.unique(Chars(column.slice(i, j - i)).grams()) for i, j in pieces(column)]
    grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))
    orders = [np.unique(grams & np.uint64((1 << (16 * k)) - 1)) for k in range(1, ORDER + 1)]
    return orders + [np.unique(x >> np.uint64(16)) for x in orders]


ASKED = "bucket int, block int, sizes array<int>, grams binary"
ANSWERED = "block int, sizes array<int>, grams binary, rows binary"


def _cut(row: dict) -> list[np.ndarray]:
    return np.split(np.frombuffer(row["grams"], np.uint64), np.cumsum(row["sizes"])[:-1])


def predicted(docs: DataFrame, known: Model | Tables) -> DataFrame:
    """The columns of docs but `text`, then lang_pred, score, entropy, rejected."""
    names = [c for c in docs.columns if c != "text"]
    schema = StructType([docs.schema[c] for c in names]).add("lang_pred", StringType()).add("score", DoubleType()).add("entropy", DoubleType()).add("rejected", BooleanType())

    def answers(model: Model, batch):
        text = rows_of(batch, "text")
        for i, j in pieces(text):
            lang, score, low, rejected = model.predict(text.slice(i, j - i))
            yield pa.RecordBatch.from_arrays([*(rows_of(batch, c).slice(i, j - i) for c in names), pa.array(lang, pa.string()), pa.array(score), pa.array(low), pa.array(rejected)], schema.names)

    if isinstance(known, Model):
        sent = docs.sparkSession.sparkContext.broadcast(known)
        return docs.mapInArrow(lambda batches: (out for batch in batches for out in answers(sent.value, batch)), schema)

    langs, floor, limit = known.langs, known.floor, known.limit
    total = text_bytes(docs)
    n_buckets = max(4, total // BUCKET_BYTES, known.cells // BUCKET_CELLS) | 1
    blocks = docs.withColumn("block", F.pmod(F.xxhash64(*docs.columns), F.lit(max(1, -(-total // BLOCK_BYTES)))).cast("int"))

    def ask(batch: pa.Table) -> pa.Table:
        wanted, rows = _wanted(rows_of(batch, "text")), []
        # packed n-grams as signed numbers, so that Spark's pmod gives the same buckets
        to = [x.view(np.int64) % n_buckets for x in wanted]
        order = [np.argsort(x, kind="stable") for x in to]
        ends = [np.searchsorted(x[o], np.arange(n_buckets + 1)) for x, o in zip(to, order, strict=True)]
        for b in range(n_buckets):
            own = [x[o[e[b] : e[b + 1]]] for x, o, e in zip(wanted, order, ends, strict=True)]
            if any(map(len, own)):
                rows.append((b, number(batch, "block"), [len(x) for x in own], np.concatenate(own).tobytes()))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary()), strict=True)], ["bucket", "block", "sizes", "grams"])

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        level, gram = rows_of(held, "level").to_numpy(), rows_of(held, "gram").to_numpy().view(np.uint64)
        value = _logs(rows_of(held, "row").flatten().to_numpy()).reshape(-1, len(langs))
        have, rows = [], []
        for k in range(2 * ORDER):
            at = np.flatnonzero(level == k)
            at = at[np.argsort(gram[at])]
            have.append((gram[at], at))
        for row in asked.to_pylist():
            hits, values = [], []
            for (grams, at), want in zip(have, _cut(row), strict=True):
                i = np.searchsorted(grams, want)
                ok = i < len(grams)
                ok[ok] = grams[i[ok]] == want[ok]
                hits.append(want[ok])
                values.append(value[at[i[ok]]])
            rows.append((row["block"], [len(x) for x in hits], np.concatenate(hits).tobytes(), np.concatenate(values).tobytes()))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, (pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary()), strict=True)], ["block", "sizes", "grams", "rows"])

    def score(batch: pa.Table, back: pa.Table) -> pa.Table:
        grams, rows = [[np.zeros(0, np.uint64)] for _ in range(2 * ORDER)], [[np.zeros((0, len(langs)), np.float32)] for _ in range(2 * ORDER)]
        for row in back.to_pylist():
            values = np.split(np.frombuffer(row["rows"], np.float32).reshape(-1, len(langs)), np.cumsum(row["sizes"])[:-1])
            for k, (g, v) in enumerate(zip(_cut(row), values, strict=True)):
                grams[k].append(g)
                rows[k].append(v)
        grams, rows = [np.concatenate(x) for x in grams], [np.concatenate(x) for x in rows]
        model = Model.of(langs, floor, limit, [Level(grams[k], rows[k], grams[ORDER + k], rows[ORDER + k]) for k in range(ORDER)])
        out = list(answers(model, batch)) if batch.num_rows else []
        return pa.Table.from_batches(out) if out else pa.table([pa.array([], t) for t in kinds], schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in schema]
    held = known.rows.withColumn("bucket", F.pmod("gram", F.lit(n_buckets)).cast("int"))
    asked = blocks.groupBy("block").applyInArrow(ask, ASKED)
    back = asked.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(lambda a, b: answer(a, b), ANSWERED)
    return with_block(blocks, back, score, schema)


def learned(counts: DataFrame) -> Model | Tables:
    """The model of all stored counts (lang, gram, n): sent as a whole where it is small, else by buckets."""
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs, n = sorted(sizes), sum(sizes.values())
    if n * len(langs) > SENT_CELLS:
        return Tables(counts, langs, n)
    got = counts.toPandas()
    return Model({k: ((g := v["gram"].to_numpy().view(np.uint64))[o := np.argsort(g)], v["n"].to_numpy()[o]) for k, v in got.groupby("lang")})


def train(rows: DataFrame) -> Model | Tables:
    """A model of all 4-grams of the rows (doc_id, text, lang) with a language.

    Rejection limits are measured on one row in CALIBRATE with a model of the others; the model returned has all rows.
    A language without a row set aside, or with none recognised there, has no limit.
    """
    rows = rows.where("lang IS NOT NULL")
    aside = F.coalesce(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("calibrate")), F.lit(CALIBRATE)) == 0, F.lit(False))
    counts = stored(gram_counts(rows.where(~aside)), "char-grams")
    part = learned(counts)
    limit = {}
    seen = predicted(rows.where(aside).select("lang", "text"), part).where("lang = lang_pred")
    for r in seen.groupBy("lang").agg(F.avg("entropy").alias("m"), F.coalesce(F.stddev("entropy"), F.lit(0.0)).alias("s")).collect():
        limit[r["lang"]] = (r["m"], max(r["s"], 0.05))
    both = counts.unionByName(gram_counts(rows.where(aside))).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    model = learned(stored(both, "char-grams"))
    model.limit = limit
    return model


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", held_out=None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, entropy, rejected.

    Learned from rows with a known language that `held_out` (a Column function of the id) does not mark; the language
    is no input of a prediction. Null texts and texts without a letter are `und` with score 0. Without training rows
    all are `und`. Repeated rows and ids give a row each.
    """
    base = slim(docs.select(docs[doc_id], docs[text]), doc_id, text)
    out = lambda c: F.coalesce(held_out(c), F.lit(False)) if held_out else F.lit(False)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"), docs[lang].cast("string").alias("lang"))
    model = train(rows.where(~out(F.col("doc_id"))))
    out_rows = predicted(base.withColumn("held_out", out(F.col("doc_id"))), model)
    return out_rows.select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


def mod4_is_2(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), held_out=mod4_is_2)
