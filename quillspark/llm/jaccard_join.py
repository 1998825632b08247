"""Jaccard self-join of word-shingle sets by signature trees, and the components of its links.

Equal sets collapse to a class. Document frequencies of all shingles give a global order, rarest first; two sets that
are similar enough share a shingle among the first n - ceil(t n) + 1 of each, and shingles of frequency 1 can be shared
with nobody. Classes that share such a shingle form a candidate group, found from (shingle, smallest class) rows. Each
group is joined by a signature tree: nodes hold OR-combined token bitmaps, the bits all members have, and size ranges;
a dual traversal drops node pairs by their largest possible overlap, and pairs of leaves are verified on the sets.

A group of more than CHUNK_SETS sets is dealt out in chunks first, each with the group's first class: what is linked
there is linked for all. A group that has unlinked members after that (unrelated sets that stock phrases chain together)
is joined once more by the lists of its prefix shingles: each list whose members are not yet linked gets its own tree,
equal lists once, long ones by bands of size. A set is then sent once for each list that it is in, not to the whole
group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._blocks import bucket_of, in_blocks, number, slimmed, split_keys, with_block
from quillspark.llm._bpe import ragged
from quillspark.llm._bytes import NOT_SPACE, HashIndex, Running, Words, mix, pieces, rows_of
from quillspark.llm._components import components
from quillspark.llm._spark import slim, stored, table

SHINGLE, PERCENT = 5, 80
#: Members and shingles of a chunk of a candidate group; children of a tree node; bytes of bitmaps compared and shingles
#: verified at a time. No task of a group holds more than about 2 * CHUNK_SETS sets.
CHUNK_SETS, CHUNK_TOKENS, FANOUT, COMPARED, VERIFIED = 512, 2_000_000, 8, 16 << 20, 1 << 20
#: Sides of the rows of a join: a chunk of a group, sets with labels, and (0 and 1) the two sides of a pair of chunks.
CHUNK, LABELLED = -2, -1


class Sets:
    """The distinct shingles of each of some texts: values first[i] .. first[i + 1] - 1, ascending."""

    def __init__(self, column: pa.Array, shingle: int = SHINGLE):
        w = Words(column, NOT_SPACE, lowered=True)
        seq, room, text = Running(w.h), w.room(), w.text_of()
        at = np.flatnonzero(room >= shingle)
        few = np.flatnonzero((w.counts > 0) & (w.counts < shingle))
        start = w.first[few]
        h = np.concatenate([seq.slices(at, at + shingle), seq.slices(start, w.first[few + 1])])
        owner = np.concatenate([text[at], few])
        # by hash, then stably by text: a radix sort where texts are few
        order = np.argsort(h)
        order = order[np.argsort(owner[order].astype(np.uint16 if len(column) < 1 << 16 else np.int64), kind="stable")]
        h, owner = h[order], owner[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        self.h, self.owner = h[new], owner[new]
        self.first = np.searchsorted(self.owner, np.arange(len(column) + 1))
        self.n = np.diff(self.first)

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that tell sets apart."""
        out = []
        for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.h + np.uint64(salt)))])
            out.append((total[self.first[1:]] - total[self.first[:-1]]).view(np.int64))
        return tuple(out)


def least_overlap(n, percent: int = PERCENT):
    """The least intersection with any set that a set of n shingles can link to."""
    return -(-n * percent // 100)


# ---- document frequencies: 32 bits of a shingle within its bucket, so that false meetings stay rare at any size

FREQ = "bucket int, block int, keys binary, counts binary"
FREQ_BACK = "block int, bucket int, keys binary, grades binary"


def _rows(schema: str, rows: list) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.table([pa.array(list(c), kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [f for f, _ in fields])


def _grade(count: np.ndarray) -> np.ndarray:
    """Frequencies in steps of a quarter power of two: 0 for 1, at most 255."""
    return np.minimum(4 * np.log2(np.maximum(count, 1)), 255).astype(np.uint8)


def _frequencies(table_: pa.Table) -> pa.Table:
    """A bucket's shingles that more than one class has, back to each block with the grade of their frequency."""
    blocks = rows_of(table_, "block").to_pylist()
    parts = [np.frombuffer(x, np.uint32) for x in rows_of(table_, "keys").to_pylist()]
    counts = [np.frombuffer(x, np.uint8).astype(np.int64) for x in rows_of(table_, "counts").to_pylist()]
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    grade = _grade(np.bincount(at, np.concatenate(counts), len(keys)))
    bucket, rows, i = number(table_, "bucket"), [], 0
    for b, k in zip(blocks, parts, strict=True):
        g = grade[at[i : i + len(k)]]
        i += len(k)
        keep = g > 0
        if keep.any():
            rows.append((b, bucket, k[keep].tobytes(), g[keep].tobytes()))
    return _rows(FREQ_BACK, rows)


class Grades:
    """Grade of each shingle of a block's sets: 0 if no other class has it."""

    def __init__(self, back: pa.Table, n_buckets: int):
        self.n, keys, grades = n_buckets, [], []
        if back.num_rows:
            for bucket, k, g in zip(rows_of(back, "bucket").to_pylist(), rows_of(back, "keys").to_pylist(), rows_of(back, "grades").to_pylist(), strict=True):
                if k is not None:
                    keys.append(self._whole(np.full(len(k) // 4, bucket), np.frombuffer(k, np.uint32)))
                    grades.append(np.frombuffer(g, np.uint8))
        keys, grades = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (grades, np.uint8)))
        order = np.argsort(keys)
        self.index, self.grades = HashIndex(keys[order]), grades[order]

    @staticmethod
    def _whole(bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
        return mix((bucket.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64))

    def of(self, h: np.ndarray) -> np.ndarray:
        row = self.index.find(self._whole(bucket_of(h, self.n), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)))
        return np.where(row >= 0, self.grades[row], 0) if len(self.grades) else np.zeros(len(h), np.uint8)


class Join:
    """Finds links among sets: a signature tree, a dual traversal, and a union-find that skips linked pairs."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT, side: np.ndarray | None = None, label: np.ndarray | None = None):
        """side: links are looked for only between sets of different sides; label: sets of one label are linked."""
        self.order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))
        self.sets, self.percent = [sets[i] for i in self.order], percent
        self.size = np.array([len(s) for s in self.sets], dtype=np.int64)
        self.side = side[self.order] if side is not None else None
        self.root = np.arange(len(sets))
        if label is not None:
            _, first, same = np.unique(label[self.order], return_index=True, return_inverse=True)
            self.root = first[same]
        self.links: list[tuple[int, int]] = []
        # shingles as numbers below `kinds`, so that one search finds a shingle in any set
        shingles, rank = np.unique(np.concatenate(self.sets), return_inverse=True)
        self.kinds, self.start, self.rank = len(shingles), np.cumsum(self.size) - self.size, rank
        self.flat = np.repeat(np.arange(len(sets)), self.size) * self.kinds + rank
        width = 256
        while width < 8 * np.median(self.size) and width < 1 << 14:
            width *= 2
        bits = np.zeros((len(sets), width), dtype=bool)
        owner = np.repeat(np.arange(len(sets)), self.size)
        bits[owner, (np.concatenate(self.sets) % np.uint64(width)).astype(np.int64)] = True
        any_ = np.packbits(bits, axis=1).view(np.uint64)
        del bits
        #: For each level from the leaves up: bits of any member, bits of all members, least and largest size.
        self.levels = [(any_, any_, self.size, self.size)]
        while len(self.levels[-1][2]) > 1:
            a, b, lo, hi = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(a, at), np.bitwise_and.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))

    def _linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs are similar enough, by the sets themselves."""
        small = np.where(self.size[a] <= self.size[b], a, b)
        large = a + b - small
        n = self.size[small]
        ask = np.repeat(large * self.kinds, n) + self.rank[ragged(self.start[small], n)]
        at = np.minimum(np.searchsorted(self.flat, ask), len(self.flat) - 1)
        both = np.add.reduceat(self.flat[at] == ask, np.cumsum(n) - n, dtype=np.int64)
        return 100 * both >= self.percent * (self.size[a] + self.size[b] - both)

    def _verify(self, a: np.ndarray, b: np.ndarray) -> None:
        """Verifies pairs that are not yet linked, in blocks after each of which the linked ones are dropped."""
        step = 64
        while len(a):
            open_ = self.root[a] != self.root[b]
            if self.side is not None:
                open_ &= self.side[a] != self.side[b]
            a, b = a[open_], b[open_]
            n = np.cumsum(np.minimum(self.size[a[:step]], self.size[b[:step]]))
            k = max(1, int(np.searchsorted(n, VERIFIED)))
            if len(a):
                good = np.flatnonzero(self._linked(a[:k], b[:k]))
                for i, j in zip(a[good].tolist(), b[good].tolist(), strict=True):
                    if self.root[i] != self.root[j]:
                        self.links.append((i, j))
                        lo, hi = sorted((self.root[i], self.root[j]))
                        self.root[self.root == hi] = lo
            a, b = a[k:], b[k:]
            step = min(4 * step, 4096)

    def _uniform(self) -> list[np.ndarray]:
        """For each level the label that all members of a node have, or -1."""
        out, low, high = [], self.root, self.root
        for level in range(len(self.levels)):
            if level:
                at = np.arange(0, len(low), FANOUT)
                low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append(np.where(low == high, low, -1))
        return out

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether some members of the nodes can still be similar enough."""
        any_, all_, lo, hi = self.levels[level]
        need = least_overlap(np.maximum(lo[a], lo[b]), self.percent)
        ok = (hi[a] >= need) & (hi[b] >= need)
        step = max(1, COMPARED // (8 * any_.shape[1]))
        at = np.flatnonzero(ok)
        for i in range(0, len(at), step):
            x, y = a[at[i : i + step]], b[at[i : i + step]]
            most = np.minimum(hi[x] - np.bitwise_count(all_[x] & ~any_[y]).sum(axis=1, dtype=np.int64), hi[y] - np.bitwise_count(all_[y] & ~any_[x]).sum(axis=1, dtype=np.int64))
            ok[at[i : i + step]] = most >= need[at[i : i + step]]
        return at[ok[at]]

    def run(self, hub: int | None = None) -> list[tuple[int, int]]:
        """Links that connect all sets which links connect, as pairs of positions in the input."""
        n = len(self.sets)
        if n > 1:
            if hub is not None:
                at = self.order.index(hub)
                rest = np.delete(np.arange(n), at)
                rest = rest[self._possible(0, np.full(n - 1, at), rest)]
                self._verify(np.full(len(rest), at), rest)
            self._verify(np.arange(n - 1), np.arange(1, n))
            uniform = self._uniform()
            a = b = np.zeros(1, dtype=np.int64)
            for level in range(len(self.levels) - 1, -1, -1):
                keep = (uniform[level][a] < 0) | (uniform[level][a] != uniform[level][b])
                a, b = a[keep], b[keep]
                ok = self._possible(level, a, b)
                a, b = a[ok], b[ok]
                if not level or not len(a):
                    break
                m, k = len(self.levels[level - 1][2]), np.arange(FANOUT)
                x = (a[:, None, None] * FANOUT + k[None, :, None]).repeat(FANOUT, axis=2).ravel()
                y = (b[:, None, None] * FANOUT + k[None, None, :]).repeat(FANOUT, axis=1).ravel()
                good = (x < m) & (y < m) & (x <= y)
                a, b = x[good], y[good]
            self._verify(a[a != b], b[a != b])
        return [(self.order[i], self.order[j]) for i, j in self.links]


def _chunk_links(percent: int):
    def links(table_: pa.Table) -> pa.Table:
        """Links of a chunk, of sets with labels, or of a pair of chunks."""
        sets = [np.frombuffer(x, np.uint64) for x in rows_of(table_, "tokens").to_pylist()]
        rep, side, label = (rows_of(table_, c).to_numpy(zero_copy_only=False) for c in ("rep", "side", "label"))
        if (side == CHUNK).any():
            found = Join(sets, percent).run(hub=int(rep.argmin()))
        else:
            found = Join(sets, percent, side if (side >= 0).all() else None, label).run()
        return pa.table([pa.array([int(rep[i]) for i, _ in found], pa.int64()), pa.array([int(rep[j]) for _, j in found], pa.int64())], ["a", "b"])

    return links


EDGES = "a long, b long"
KEYS = "kind int, bucket int, block int, keys binary, reps binary"
TOKENS = "comp long, x int, y int, side int, label long, rep long, tokens binary"
LISTED = "block int, comp long, key long, rep long, p long, label long, n long"


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, class_id.

    Words are maximal runs of other characters than ASCII white space, A-Z lower-cased. A set has the distinct
    `shingle`-word shingles; with fewer words the whole sequence is the one shingle. Texts link when
    100 * intersection >= percent * union. class_id is the smallest id of a row with the same set, component_id the
    smallest id that links reach. Null texts and texts without words have no shingles, link with nothing, and are
    their own class and component. Rows that repeat an id take part each with its own text.
    """
    cut = in_blocks(slim(docs, doc_id, text))
    blocks, n_buckets = cut.docs, cut.buckets(cut.bytes // 6)

    def prints(batches):
        for batch in batches:
            column, ids, block = (rows_of(batch, c) for c in ("text", "doc_id", "block"))
            for i, j in pieces(column):
                s = Sets(column.slice(i, j - i), shingle)
                yield pa.RecordBatch.from_arrays([block.slice(i, j - i), ids.slice(i, j - i), pa.array(s.n), *map(pa.array, s.prints())], ["block", "doc_id", "n", "p", "q"])

    rows = stored(blocks.mapInArrow(prints, "block int, doc_id long, n long, p long, q long"), "set-prints")
    least = F.min(F.struct("doc_id", "block")).alias("least")
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "p", "q").agg(least)
    classes = stored(classes.select("n", "p", "q", F.col("least.doc_id").alias("rep"), F.col("least.block").alias("block")), "classes")
    reps = classes.select("block", "rep", "p")

    def own_sets(docs_: pa.Table, chosen: dict[tuple[int, int], int]):
        """(sets, (rep, index of the set) ..) for each class whose first row lies in this block, once; only rows with the id
        of a class are looked at."""
        ids = rows_of(docs_, "doc_id")
        docs_ = docs_.filter(pc.is_in(ids, pa.array(sorted({r for r, _ in chosen}), pa.int64())))
        column, ids = rows_of(docs_, "text"), rows_of(docs_, "doc_id").to_pylist()
        left = set(chosen)
        for i, j in pieces(column):
            s = Sets(column.slice(i, j - i), shingle)
            at = []
            for x, key in enumerate(zip(ids[i:j], s.prints()[0].tolist(), strict=True)):
                if key in left:
                    left.discard(key)
                    at.append((key[0], x))
            yield s, at

    def chosen_of(back: pa.Table) -> dict[tuple[int, int], int]:
        rep, p = rows_of(back, "rep").to_pylist(), rows_of(back, "p").to_pylist()
        return {(r, q): k for k, (r, q) in enumerate(zip(rep, p, strict=True)) if r is not None}

    def first(docs_: pa.Table, back: pa.Table) -> pa.Table:
        if not back.num_rows or not docs_.num_rows:
            return _rows(FREQ, [])
        parts = []
        for s, at in own_sets(docs_, chosen_of(back)):
            keep = np.zeros(len(s.n), dtype=bool)
            keep[[x for _, x in at]] = True
            parts.append(s.h[keep[s.owner]])
        keys = np.concatenate([np.zeros(0, np.uint64), *parts])
        del parts
        keys.sort()
        head = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)))
        keys, count = keys[head], np.diff(np.append(head, len(keys)))
        low, count = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(count, 255).astype(np.uint8)
        b = number(docs_, "block")
        return _rows(FREQ, [(k, b, low[x:y].tobytes(), count[x:y].tobytes()) for k, x, y in split_keys(keys, n_buckets)])

    def prefixes(docs_: pa.Table, back: pa.Table, chosen: dict):
        """(rep, index of the set in its piece, prints, prefix shingles) of each chosen set that can have links."""
        grades = Grades(back, n_buckets) if chosen else None
        for s, at in own_sets(docs_, chosen) if chosen else ():
            grade, p = grades.of(s.h), s.prints()[0]
            for rep, x in at:
                h, g = s.h[s.first[x] : s.first[x + 1]], grade[s.first[x] : s.first[x + 1]]
                n = len(h)
                here = np.flatnonzero(g)
                if len(here) < least_overlap(n, percent):
                    continue
                most = n - least_overlap(n, percent) + 1 - (n - len(here))
                yield rep, int(p[x]), n, h[here[np.lexsort((h[here], g[here]))[:most]]]

    def second(docs_: pa.Table, back: pa.Table) -> pa.Table:
        """Links of each class to the smallest class of this block with the same prefix shingle, those for buckets, and the
        prefix of each class."""
        if not back.num_rows or not docs_.num_rows:
            return _rows(KEYS, [])
        keys, about = [], []
        for rep, p, n, h in prefixes(docs_, back, chosen_of(back)):
            keys.append(h)
            about.append((rep, p, n, len(h)))
        if not keys:
            return _rows(KEYS, [])
        keys, about, b = np.concatenate(keys), np.array(about, np.int64), number(docs_, "block")
        kept = (2, 0, b, keys.tobytes(), about.tobytes())
        keys, heads, edges = _to_first(keys, np.repeat(about[:, 0], about[:, 3]))
        out = [kept, *((0, k, b, keys[x:y].tobytes(), heads[x:y].tobytes()) for k, x, y in split_keys(keys, n_buckets))]
        return _rows(KEYS, [*out, (1, 0, b, edges[:, 0].tobytes(), edges[:, 1].tobytes())])

    frequencies = stored(with_block(blocks, reps, first, FREQ).groupBy("bucket").applyInArrow(slimmed(_frequencies), FREQ_BACK), "grades")
    back = frequencies.unionByName(reps, allowMissingColumns=True)
    keyed = stored(with_block(blocks, back, second, KEYS), "prefix-keys")
    meet = keyed.where("kind = 0").groupBy("bucket").applyInArrow(slimmed(_meet_first), EDGES)
    near = keyed.where("kind = 1").mapInArrow(_open_edges, EDGES)
    groups = stored(components(meet.unionByName(near)), "groups")

    # candidate groups in chunks
    sized = groups.join(classes.select(F.col("rep").alias("node"), "n", "p").dropDuplicates(["node"]), "node")
    sums = sized.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    chunks = F.ceil(F.greatest(F.col("m") / CHUNK_SETS, F.col("t") / CHUNK_TOKENS)).cast("int")
    # a class that repeated ids share with another one keeps each of its sets
    members = groups.join(classes.select(F.col("rep").alias("node"), "p", "block"), "node").join(sums.select("root", chunks.alias("chunks")), "root")
    where = F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")))
    members = stored(members.select("block", "root", "node", "p", "chunks", where.alias("where")), "members")

    def third(docs_: pa.Table, back: pa.Table) -> pa.Table:
        """The sets of a block's members for each chunk, or pair of chunks, that they are in."""
        if not back.num_rows or not docs_.num_rows:
            return _rows(TOKENS, [])
        to: dict[tuple[int, int], list] = {}
        for r in back.select(["rep", "p", "comp", "x", "y", "side", "label"]).to_pylist():
            to.setdefault((r["rep"], r["p"]), []).append((r["comp"], r["x"], r["y"], r["side"], r["label"]))
        out = []
        for s, at in own_sets(docs_, to):
            p = s.prints()[0]
            for rep, x in at:
                raw = s.h[s.first[x] : s.first[x + 1]].tobytes()
                out += [(*t, rep, raw) for t in to[rep, int(p[x])]]
        return _rows(TOKENS, out)

    def links(to: DataFrame) -> DataFrame:
        to = to.select("block", "rep", "p", "comp", "x", "y", "side", "label")
        return with_block(blocks, to, third, TOKENS).groupBy("comp", "x", "y").applyInArrow(slimmed(_chunk_links(percent)), EDGES)

    none = F.lit(-1)
    own = members.select("block", F.col("node").alias("rep"), "p", F.col("root").alias("comp"), F.explode("where").alias("x"), none.alias("y"), F.lit(CHUNK).alias("side"), none.cast("long").alias("label"))
    found = stored(links(own), "links")
    parts = components(found)
    big = members.where("chunks > 1")
    if big.limit(1).count():
        state = big.join(parts, "node", "left").select("block", members["root"].alias("comp"), members["node"].alias("rep"), "p", F.coalesce(parts["root"], members["node"]).alias("label"))
        open_ = state.groupBy("comp").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("comp")
        state = stored(state.join(open_, "comp", "left_semi"), "unlinked-groups")
        # the prefixes are kept from the pass that made them: grades and texts of whole blocks are not needed again
        kept = keyed.where("kind = 2").select("block", "keys", "reps").join(state.select("block").distinct(), "block", "left_semi")
        lists = stored(with_block(kept, state, _prefix_lists, LISTED), "prefix-lists")
        found = stored(found.unionByName(links(_by_list(lists, percent))), "links")
        parts = components(found)
    parts = parts.select(F.col("node").alias("rep"), "root")
    named = classes.join(parts, "rep", "left").select("n", "p", "q", "rep", F.coalesce("root", "rep").alias("root"))
    out = rows.join(named, ["n", "p", "q"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"))


def _prefix_lists(kept: pa.Table, back: pa.Table) -> pa.Table:
    """The lists of prefix shingles that a block's members of unlinked groups are in."""
    if not kept.num_rows or not back.num_rows:
        return _rows(LISTED, [])
    groups = {(r["rep"], r["p"]): (r["comp"], r["label"]) for r in back.select(["rep", "p", "comp", "label"]).to_pylist()}
    block, out, i = number(kept, "block"), [], 0
    keys = np.frombuffer(rows_of(kept, "keys")[0].as_py(), np.int64)
    for rep, p, n, m in np.frombuffer(rows_of(kept, "reps")[0].as_py(), np.int64).reshape(-1, 4).tolist():
        if (rep, p) in groups:
            comp, label = groups[rep, p]
            out += [(block, comp, key, rep, p, label, n) for key in keys[i : i + m].tolist()]
        i += m
    return _rows(LISTED, out)


def _by_list(lists: DataFrame, percent: int) -> DataFrame:
    """Rows of links(): for each list with members that are not yet linked, its members, equal lists once.

    Lists of more than CHUNK_SETS members are cut by size: sets that can link lie in the same band or in neighbouring
    ones, so a set goes to the cell of its band and to the next. What is still too long is joined by pairs of chunks.
    """
    size = [F.count("*").alias("m"), F.sum("n").alias("t"), F.min("label").alias("lo"), F.max("label").alias("hi")]
    print_ = F.sum(F.xxhash64("rep", "p").cast("decimal(38,0)")).alias("members")
    known = lists.groupBy("comp", "key").agg(*size, print_).where("lo <> hi").groupBy("comp", "m", "members").agg(F.min(F.struct("key", "t")).alias("k"))
    known = known.select("comp", F.col("k.key").alias("key"), ((F.col("m") > CHUNK_SETS) | (F.col("k.t") > CHUNK_TOKENS)).alias("long"))
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int")
    cell = F.explode(F.when(F.col("long"), F.array(band, band + 1)).otherwise(F.array(F.lit(-1)))).alias("cell")
    cells = lists.join(known, ["comp", "key"]).select("block", F.xxhash64("comp", "key").alias("comp"), "rep", "p", "label", "n", cell)
    chunks = F.ceil(F.greatest(F.col("m") / CHUNK_SETS, F.col("t") / CHUNK_TOKENS)).cast("int").alias("chunks")
    open_ = cells.groupBy("comp", "cell").agg(*size).where("lo <> hi").select("comp", "cell", chunks)
    dealt = cells.join(open_, ["comp", "cell"]).withColumn("comp", F.xxhash64("comp", "cell")).withColumn("own", F.pmod(F.xxhash64("rep", "p"), F.col("chunks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("own") == F.col("other"), LABELLED).otherwise((F.col("own") > F.col("other")).cast("int"))
    return other.select("block", "rep", "p", "comp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), side.alias("side"), "label")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, all columns, whose id is the smallest of its component.

    Rows without words are linked with nothing and stay, and so do rows with a null id. Of rows that repeat an id of a
    component one stays.
    """
    found = stored(jaccard_components(docs, doc_id, text, shingle, percent), "components")
    keep = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("times"))
    keep = stored(keep, "kept-ids")
    ids = docs[doc_id].cast("long")
    out = docs.join(keep.select(F.col("doc_id").alias("__kept")), ids == F.col("__kept"), "left_semi")
    if keep.where("times > 1").limit(1).count():
        out = out.dropDuplicates([doc_id])
    if found.where("doc_id IS NULL").limit(1).count():
        out = out.unionByName(docs.where(docs[doc_id].isNull()))
    return out


def _to_first(keys: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, the smallest class of each, distinct links of classes to it)."""
    order = np.lexsort((reps, keys))
    keys, reps = keys[order], reps[order]
    head = np.ones(len(keys), dtype=bool)
    head[1:] = keys[1:] != keys[:-1]
    first = reps[head][np.cumsum(head) - 1]
    apart = reps != first
    edges = np.unique(np.column_stack([reps[apart], first[apart]]), axis=0) if apart.any() else np.zeros((0, 2), np.int64)
    return keys[head], reps[head], edges


def _meet_first(table_: pa.Table) -> pa.Table:
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in rows_of(table_, "keys").to_pylist()])
    reps = np.concatenate([np.frombuffer(x, np.int64) for x in rows_of(table_, "reps").to_pylist()])
    _, _, edges = _to_first(keys, reps)
    return pa.table([pa.array(np.ascontiguousarray(edges[:, 0])), pa.array(np.ascontiguousarray(edges[:, 1]))], ["a", "b"])


def _open_edges(batches):
    for batch in batches:
        for a, b in zip(rows_of(batch, "keys").to_pylist(), rows_of(batch, "reps").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.int64))], ["a", "b"])


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("class_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) AS m ON m.a = w.doc_id
"""
