"""Each operator against a brute-force version, the library, or held-out rows; edge cases throughout."""

from __future__ import annotations

import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

sys.path.insert(0, str(Path(__file__).resolve().parent))
import helpers as H

from quillspark.llm import _bpe, decontamination, difference_cover, exact_dedup, jaccard_join, language_id, mixing, run_index, token_counts, token_output, toxicity

ROWS = H.corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return H.with_clashes(spark.createDataFrame(ROWS, H.SCHEMA).repartition(5))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], H.SCHEMA)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def order(rows):
    return sorted(rows, key=str)


def test_run_index(docs):
    assert rows_of(run_index.repeated_bytes(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == order(H.brute_bytes(ROWS))


def test_run_index_splits_keys_of_many_contexts(spark, docs, monkeypatch):
    """Down to single windows: a line shorter than a window, between different words, in every text."""
    monkeypatch.setattr(run_index, "MOST_CONTEXTS", 1)
    monkeypatch.setattr(run_index, "BLOCK_CONTEXTS", 1)
    assert rows_of(run_index.repeated_bytes(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == order(H.brute_bytes(ROWS))
    line = H.words(400, 30)
    rows = [(i, H.words(500 + i, 30) + " " + line + " " + H.words(600 + i // 2, 40) + " " + H.words(700 + i, 30)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(run_index.repeated_bytes(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == order(H.brute_bytes(rows)) and sum(r[2] for r in got) > 0


def test_run_index_splits_in_few_passes(spark, monkeypatch):
    """Workers see the limits here. A passage in every text is split down to single windows by three passes over the texts."""
    passes, plain = [], run_index.stored
    monkeypatch.setattr(run_index, "MOST_CONTEXTS", 4)
    monkeypatch.setattr(run_index, "stored", lambda df, what: passes.append(what) or plain(df, what))
    line = H.words(400, 60)
    rows = [(i, H.words(500 + i, 30) + " " + line + " " + H.words(600 + i // 2, 40) + " " + H.words(700 + i, 30)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cloudpickle.register_pickle_by_value(run_index)
    try:
        got = rows_of(run_index.repeated_bytes(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    finally:
        cloudpickle.unregister_pickle_by_value(run_index)
    assert got == order(H.brute_bytes(rows)) and len(line) > 200
    assert passes == ["contexts"] * 3


def test_run_index_splits_only_windows_of_split_keys():
    """Contexts of a further depth cover the windows of the split keys and no others."""
    c = run_index.Contexts(pa.array([H.words(i, 400) for i in range(5)]))
    n, key, split = int(c.n.sum()), c.key[:3].copy(), int(c.n[:3].sum())
    assert [int(x.n.sum()) for x in c.depths([run_index.HashIndex(np.sort(key))])] == [n, split]


def test_run_index_orders_anchors_by_32_bits_in_short_texts_too(monkeypatch):
    """Grams that tie in the leading 32 bits of their hash pick the first position, whatever the later bits are."""
    plain = run_index.bytes_hash

    def tied(data):
        run = plain(data)
        slices = run.slices
        run.slices = lambda s, e: slices(s, e) & np.uint64(0xFFFFFFFF)
        return run

    monkeypatch.setattr(run_index, "bytes_hash", tied)
    c = run_index.Contexts(pa.array([H.words(3, 200)]))
    assert len(c.start) and (c.pick == c.start).all()


def test_run_index_longest_matches():
    r = np.random.default_rng(3)
    strings = [bytes(r.integers(97, 99, n, dtype=np.uint8)) for n in r.integers(1, 60, 40)] + [b"abab" * 9, b"abab" * 9, b"a"]
    text = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    ends = np.repeat(np.cumsum(sizes), sizes)
    got = run_index.RunIndex(text, ends).longest()
    raw = text.tobytes()

    def brute(i):
        best = 0
        for j in range(len(raw)):
            if j != i:
                k = 0
                while i + k < ends[i] and j + k < ends[j] and raw[i + k] == raw[j + k]:
                    k += 1
                best = max(best, k)
        return best

    assert got.tolist() == [brute(i) for i in range(len(raw))]
    assert len(run_index.RunIndex(text, ends).run_size) < len(raw)


def test_difference_cover(docs):
    assert difference_cover.is_cover(difference_cover.COVER, difference_cover.PERIOD)
    assert rows_of(difference_cover.repeated_windows(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == order(H.brute_words(ROWS))


def test_difference_cover_rejects_a_set_that_is_none(docs):
    with pytest.raises(ValueError):
        difference_cover.repeated_windows(docs, residues=(0, 1, 2))


ITEMS = [(3, " ".join(ROWS[0][1].split(" ")[5:30])), (12, "one two three"), (7, "one two three"), (1, "ONE"), (None, " ".join(ROWS[1][1].split(" ")[0:10])), (5, None), (6, " ,, "), (8, ROWS[4][1][:200])]


@pytest.mark.parametrize("block_words", [2_000_000, 20])
def test_decontamination(spark, docs, block_words):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.contamination(docs, items, block_words=block_words)
    want = H.brute_contamination(ROWS, ITEMS)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == order(want)
    clean = decontamination.clean_rows(docs, items, block_words=block_words)
    assert clean.columns == docs.columns
    assert rows_of(clean, "doc_id", "text") == order([(r[0], r[1]) for r, w in zip(ROWS, want, strict=True) if not w[-1]])


def test_token_counts(docs):
    t = _bpe.tokenizer(token_counts.PATH)
    n = [len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in ROWS]
    want = [(r[0], len((r[1] or "").encode()), k, k > 512) for r, k in zip(ROWS, n, strict=True)]
    assert rows_of(token_counts.token_counts(docs), "doc_id", "n_bytes", "n_tokens", "over_limit") == order(want)


HARD = ["it's they're I'll we've I'd I'm 'steam ''s !'s 's  's\n's x's's'", "a\x85b \x85\x85b\xa0\xa0c  d", "  lead  trail  ", "\n\n a\n\n", "a\x1cb", "", "  ", "1234 ab12 12ab ²³½ ½x", "tab\t\tx\t y", "don'tre 'really 'l 'v", "​z", "'", "a'", "'S", "  '", "é'ss ", "͸ x", "<|endoftext|>", "a<|endoftext|><|endoftext|>"]


def test_pieces_are_the_librarys():
    import pyarrow as pa

    e = _bpe.Encoder(token_counts.PATH, _bpe.PieceTable.empty())
    for texts in (HARD, HARD[::-1]):
        k, ids = e.ids(pa.array(texts, pa.string()))
        off, want = _bpe.encoded(token_counts.PATH, texts)
        assert k.tolist() == np.diff(off).tolist() and ids.tolist() == want.tolist()


def test_joined_pieces_are_the_librarys():
    words = [" " + w for w in H.words(77, 900, 5000).split(" ")] + [" é", " 中文", " ", "x", " a1", "  b", " 's", " don't", " ǅ", " ª", " a\u0301", "\n", " \U00010428\U00010429"] * 40
    off, ids = _bpe.encoded_pieces(token_counts.PATH, words)
    off2, ids2 = _bpe.encoded(token_counts.PATH, words)
    assert off.tolist() == off2.tolist() and ids.tolist() == ids2.tolist()
    assert [x.tolist() for x in _bpe.encoded_pieces(token_counts.PATH, [])] == [[0], []]


def test_token_output(docs):
    t = _bpe.tokenizer(token_output.PATH)
    want, at = [], 0
    for r in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_output.read_documents(token_output.write_frames(docs))
    assert rows_of(got, "doc_id", "start", "n_tokens", "ids_crc32") == order(want)


def test_grammar_round_trip():
    r = np.random.default_rng(1)
    for ids in (np.zeros(1000, np.int32), r.integers(0, 50, 30000).astype(np.int32), np.tile(r.integers(0, 50257, 37), 500).astype(np.int32), np.zeros(0, np.int32), np.array([5], np.int32)):
        symbols, left, right = token_output.compress(ids, 50257)
        assert (token_output.expand(symbols, left, right, 50257) == ids).all()
        spans = token_output.spans_of(left, right, 50257)
        frame = token_output.packed(ids, 50257)
        assert frame["width"] == 2 and frame["spans"] == spans.astype("<u4").tobytes()
        for a, b in ((0, 1), (3, 200), (len(ids) - 5, len(ids))):
            if 0 <= a < b <= len(ids):
                assert (token_output.ids_between(frame, a, b) == ids[a:b]).all()
    assert len(token_output.compress(np.zeros(1000, np.int32), 50257)[0]) < 30


def test_grammar_has_no_frequent_pair_left():
    """Rules go on until no pair has LEAST_USES places that do not overlap."""
    r = np.random.default_rng(3)
    passage = r.integers(0, 50257, 6000)
    skewed = np.minimum(r.zipf(1.3, 60000), 50000)
    for ids in (np.tile(passage, 20), skewed, np.zeros(50000, np.int64)):
        symbols, left, right = token_output.compress(ids.astype(np.int32), 50257)
        assert (token_output.expand(symbols, left, right, 50257) == ids).all()
        count: dict = {}
        last: dict = {}
        for i, p in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True)):
            if last.get(p, -2) != i - 1:
                count[p], last[p] = count.get(p, 0) + 1, i
        assert max(count.values(), default=0) < token_output.LEAST_USES


def test_grammar_of_many_rules_or_ids_has_wide_symbols():
    r = np.random.default_rng(4)
    for ids, base in ((np.tile(r.integers(0, 50257, 70000), 4), 50257), (np.tile(r.integers(0, 200000, 300), 9), 200000)):
        frame = token_output.packed(ids, base)
        assert frame["width"] == 4
        for a, b in ((0, 5), (len(ids) // 2, len(ids) // 2 + 700), (len(ids) - 9, len(ids))):
            assert (token_output.ids_between(frame, a, b) == ids[a:b]).all()
        assert (token_output.expand(*(token_output._numbers(frame, c) for c in ("symbols", "left", "right")), base) == ids).all()


def test_grammar_takes_the_most_frequent_pair_first():
    """x y is more frequent than y z: where they overlap, x y is replaced."""
    ids = np.array([1, 2, 3] * 20 + [1, 2, 9, 1, 2, 8] * 10 + [2, 3, 7] * 5)
    _, left, right = token_output.compress(ids, 10)
    assert (left[0], right[0]) == (1, 2)


def test_token_output_in_the_order_of_rows(spark):
    rows = [(9, "one two"), (3, None), (9, "one two"), (None, "three"), (1, "")]
    frames = token_output.write_frames(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), by_id=False)
    got = token_output.read_documents(frames).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got][:-1]).tolist()


def test_exact_dedup(docs):
    want = H.brute_exact(ROWS)
    got = exact_dedup.exact_duplicates(docs, digest_all=True)
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept", "digest") == order(want)
    some = exact_dedup.exact_duplicates(docs)
    assert rows_of(some, "doc_id", "keep_id", "group_size", "kept") == order([w[:4] for w in want])


def test_exact_dedup_is_native(docs):
    plan = exact_dedup.exact_duplicates(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_exact_dedup_without_broadcast(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    assert rows_of(exact_dedup.exact_duplicates(docs, digest_all=True), "doc_id", "keep_id", "group_size", "kept", "digest") == order(H.brute_exact(ROWS))


def test_exact_dedup_of_hot_groups(spark, docs, monkeypatch):
    """Groups above the limit are broadcast; where they are too many, only the largest."""
    monkeypatch.setattr(exact_dedup, "HOT_GROUP", 2)
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 1)
    rows = [(i, "same" if i % 3 == 0 else f"text {i % 40}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for given, want in ((docs, ROWS), (df, rows)):
        for every in (True, False):
            got = exact_dedup.exact_duplicates(given, digest_all=every)
            assert rows_of(got, "doc_id", "keep_id", "group_size", "kept") == order([w[:4] for w in H.brute_exact(want)])


def test_exact_dedup_takes_ids_of_text(spark):
    got = exact_dedup.exact_duplicates(spark.createDataFrame([("b", "x y"), ("a", "xy "), ("c", None)], "doc_id string, text string"))
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept") == [("a", "a", 2, True), ("b", "a", 2, False), ("c", "c", 1, True)]


def known(rows):
    """Without the row that has no id: only its shingles are fixed."""
    return order(r for r in rows if r[0] is not None)


@pytest.mark.parametrize("chunk", [1024, 3])
def test_jaccard_join(docs, chunk, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK_SETS", chunk)
    got = [tuple(r) for r in jaccard_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert len(got) == len(ROWS) and known(got) == known(H.brute_jaccard(ROWS))


def test_jaccard_chunks_find_all_links(spark, monkeypatch):
    """A large group whose members link only in parts, dealt out in chunks of three."""
    monkeypatch.setattr(jaccard_join, "CHUNK_SETS", 3)
    rows = []
    for g in range(4):
        base = H.words(200, 100).split(" ")
        base[30 * (g % 3) : 30 * (g % 3) + 12] = H.words(300 + g, 12).split(" ")
        for k in range(6):
            w = list(base)
            if k:
                w[(7 * k + 11 * g) % 100] = f"edit{k}"
            rows.append((100 * g + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_components(df).select("doc_id", "n_shingles", "component_id")
    assert order(tuple(r) for r in got.collect()) == order(H.brute_jaccard(rows))


def test_jaccard_lists_come_from_kept_prefixes(spark, monkeypatch):
    """Unlinked groups are joined by the prefixes that the first pass kept: grades go to blocks once, texts are read four times."""
    backs, plain = [], jaccard_join.with_block

    def seen(docs, back, f, schema):
        backs.append(("text" in docs.columns, "grades" in back.columns))
        return plain(docs, back, f, schema)

    monkeypatch.setattr(jaccard_join, "with_block", seen)
    monkeypatch.setattr(jaccard_join, "CHUNK_SETS", 3)
    phrase = [H.words(20_000 + i, 8) for i in range(42)]
    rows = [(i, " ".join(phrase[i : i + 3])) for i in range(40)] + [(40 + i, " ".join(phrase[i : i + 3]) + " end") for i in range(0, 40, 5)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "n_shingles", "component_id")
    assert order(tuple(r) for r in got.collect()) == order(H.brute_jaccard(rows))
    assert len(backs) == 5 and sum(t for t, _ in backs) == 4 and sum(g for _, g in backs) == 1


def test_jaccard_chain_of_stock_phrases(spark, monkeypatch):
    """Sets that share phrases with their neighbours, none similar enough: one group, nothing linked, rows linear in it."""
    n, sent = 5000, []
    phrase = [H.words(10_000 + i, 8) for i in range(n + 2)]
    rows = [(i, " ".join(phrase[i : i + 3])) for i in range(n)] + [(n + i, " ".join(phrase[i : i + 3]) + " end") for i in range(0, n, 500)]
    plain = jaccard_join._by_list

    def counted(*args):
        out = plain(*args)
        sent.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "_by_list", counted)
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["component_id"] == (r["doc_id"] if r["doc_id"] < n else r["doc_id"] - n)
    # a set is in few lists, though the group has all sets
    assert sent and 0 < sent[0] < 8 * n


def test_one_of_each(docs):
    got = [tuple(r) for r in jaccard_join.one_of_each(docs).select("doc_id").collect()]
    roots = {c for i, _, c in H.brute_jaccard(ROWS) if i is not None}
    assert sorted(i for (i,) in got if i is not None) == sorted(roots)
    assert jaccard_join.one_of_each(docs).columns == docs.columns


def test_mix(spark, docs):
    out = mixing.mix(docs)
    assert set(docs.columns) <= set(out.columns) and {"mix_copy", "mix_key"} <= set(out.columns)
    rates = {r["source"]: r for r in mixing.source_rates(docs).collect()}
    assert abs(sum(r["weight"] for r in rates.values()) - 1) < 1e-9 and None in rates
    per = {}
    for r in out.select("doc_id", "text", "mix_copy").collect():
        per.setdefault((r[0], r[1]), []).append(r[2])
    assert all(sorted(v)[0] == 0 for v in per.values())
    keys = [r[0] for r in out.select("mix_key").collect()]
    assert keys == sorted(keys)


def test_mix_reaches_the_weights(spark):
    df = spark.range(20000).selectExpr("id AS doc_id", "'abcdefghij' AS text", "if(id < 6000, 'hot', concat('s', id % 5)) AS source")
    out = mixing.mix(df, weights={"hot": 0.1, "s0": 0.5, "s1": 0.4}, epochs=1.5)
    n = {r[0]: r[1] for r in out.groupBy("source").count().collect()}
    assert set(n) == {"hot", "s0", "s1"}
    for s, share in (("hot", 0.1), ("s0", 0.5), ("s1", 0.4)):
        assert abs(n[s] / 30000 - share) < 0.02
    assert len(mixing.poisson_steps(2000.0)) > 2000 and mixing.poisson_steps(0.0) == []


def test_language_id(spark, sf_dir):
    out = language_id.op3_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)


def test_language_id_edges(docs):
    out = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(docs, held_out=language_id.mod4_is_2).collect()}
    und = {i for i, p, _ in out if p == "und"}
    assert und == {r[0] for r in ROWS if not any(c.isalpha() for c in r[1] or "")}
    assert {p for _, p, _ in out} <= {"und", "en", "de"}


def few_of_one_language(n_large: int = 300):
    """A large language, a small one of two rows in other letters, and unlabelled texts of both."""
    r = np.random.default_rng(5)
    word = lambda low, high: "".join(chr(x) for x in r.integers(low, high, 6))
    large = [" ".join(word(0x4E00, 0x4E80) for _ in range(40)) for _ in range(n_large)]
    small = [" ".join(word(0x61, 0x7B) for _ in range(40)) for _ in range(2)]
    rows = [(i, t, "zh") for i, t in enumerate(large)] + [(1000 + i, t, "aa") for i, t in enumerate(small)]
    return rows + [(2000, large[0][:80], None), (2001, small[0][:80], None), (2002, "12 !", None), (2003, None, None)]


def test_language_id_keeps_all_grams(spark):
    """Singletons of a small language stay in the model beside a large one."""
    df = spark.createDataFrame(few_of_one_language(), "doc_id long, text string, lang string")
    # ids 1000 and 1001 must both be counted, not set aside
    model = language_id.train(df)
    assert model.langs == ["aa", "zh"]
    grams = {int(x) for r in few_of_one_language() if r[2] for x in language_id.Chars(pa.array([r[1]])).grams().tolist()}
    assert len(model.levels[-1].index.keys) > 0.9 * len(grams) > 10000
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df).collect()}
    assert out[2000] == "zh" and out[2001] == "aa" and out[2002] == out[2003] == "und"


def test_language_id_discounts_from_all_counts(spark):
    """The top order's discount comes from the true numbers of 4-grams seen once and twice."""
    rows = few_of_one_language(60)
    small = [r for r in rows if r[2] == "aa"]
    model = language_id.train(spark.createDataFrame(small, "doc_id long, text string, lang string"))
    grams, n = np.unique(language_id.Chars(pa.array([r[1] for r in small])).grams(), return_counts=True)
    d = (n == 1).sum() / ((n == 1).sum() + 2 * max((n == 2).sum(), 1))
    head, at = np.unique(grams >> np.uint64(16), return_inverse=True)
    expect = np.minimum(d * np.bincount(at) / np.bincount(at, n), 1.0)
    top = model.levels[-1]
    assert d > 0.5 and np.allclose(np.exp(top.weight[top.contexts.find(language_id.mix(head)), 0]), expect, rtol=1e-5)


def test_language_id_learns_rows_set_aside(spark):
    """A language whose only row is set aside for calibration is learned all the same."""
    from pyspark.sql import functions as F

    aside = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("calibrate")), F.lit(language_id.CALIBRATE)) == 0
    only = spark.range(3000, 3200).where(aside).first()[0]
    rows = [r for r in few_of_one_language(20) if r[2] != "aa"] + [(only, few_of_one_language(20)[20][1], "aa")]
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert out[only] == out[2001] == "aa" and out[2000] == "zh"


def kneser_ney(rows, text):
    """Cross-entropy per symbol of a text under each language, from dicts: the textbook formula, order 4."""
    import unicodedata

    def symbols(t):
        out = []
        for ch in t:
            if unicodedata.category(ch)[0] == "L":
                low = ch.lower()
                raw = (low if len(low) == 1 else ch).encode("utf-16-le")
                out += [raw[i : i + 2] for i in range(0, len(raw), 2)]
            elif not out or out[-1] != " ":
                out.append(" ")
        return ["^"] * 3 + out

    def grams(t, n):
        s = symbols(t)
        return [tuple(s[i - n + 1 : i + 1]) for i in range(3, len(s))]

    langs = sorted({r[2] for r in rows if r[2]})
    counts = {}
    for lang in langs:
        c: dict = {}
        for r in rows:
            for g in grams(r[1], 4) if r[2] == lang else ():
                c[g] = c.get(g, 0) + 1
        counts[lang] = [c]
        for _ in range(3):
            low: dict = {}
            for g in counts[lang][0]:
                low[g[1:]] = low.get(g[1:], 0) + 1
            counts[lang].insert(0, low)
    vocab = len({g for c in counts.values() for g in c[0]}) + 1

    def p(c, g):
        if not g:
            return 1 / vocab
        own = c[len(g) - 1]
        n1, n2 = max(sum(v == 1 for v in own.values()), 1), max(sum(v == 2 for v in own.values()), 1)
        d = n1 / (n1 + 2 * n2)
        after = [v for k, v in own.items() if k[:-1] == g[:-1]]
        if not after:
            return p(c, g[1:])
        return max(own.get(g, 0) - d, 0) / sum(after) * (g in own) + min(d * len(after) / sum(after), 1) * p(c, g[1:])

    found = grams(text, 4)
    return {lang: -sum(np.log(p(counts[lang], g)) for g in found) / len(found) for lang in langs}


def test_language_id_equals_brute_force(spark, monkeypatch):
    """Entropies of a model that train() made, sent whole or in buckets, are those of the formula."""
    wide = "".join(chr(0x10400 + i) for i in range(12)) + " " + "".join(chr(0x10428 + 2 * i) for i in range(9))
    rows = [(i, H.words(800 + i, 12) + (" " + wide if i % 4 == 0 else ""), ["aa", "bb"][i % 2]) for i in range(20)]
    asked = [(100, H.words(900, 6)), (101, wide[3:9] + " x"), (102, rows[3][1]), (103, "zzz " + H.words(901, 3))]
    want = {i: kneser_ney(rows, t) for i, t in asked}
    df = spark.createDataFrame([*rows, *[(i, t, None) for i, t in asked]], "doc_id long, text string, lang string")
    for cells in (language_id.SENT_CELLS, 0):
        monkeypatch.setattr(language_id, "SENT_CELLS", cells)
        for r in language_id.identify(df).where("doc_id >= 100").collect():
            e = want[r["doc_id"]]
            assert abs(r["entropy"] - min(e.values())) < 1e-4 and r["lang_pred"] == min(e, key=e.get)


def test_language_id_tells_letters_beyond_16_bits_apart(spark):
    """Two languages whose letters all lie beyond 16 bits."""
    r = np.random.default_rng(8)
    word = lambda low: "".join(chr(x) for x in r.integers(low, low + 20, 6))
    rows = [(i, " ".join(word([0x10400, 0x10A00][i % 2]) for _ in range(20)), ["dsr", "khr"][i % 2]) for i in range(40)]
    out = {x["doc_id"]: x for x in language_id.identify(spark.createDataFrame([*rows, (100, rows[0][1][:30], None), (101, rows[1][1][:30], None)], "doc_id long, text string, lang string")).collect()}
    assert (out[100]["lang_pred"], out[101]["lang_pred"]) == ("dsr", "khr") and out[100]["score"] > 0.9


def test_language_id_by_buckets(spark, docs, sf_dir, monkeypatch):
    """A model too large to broadcast gives the answers of the one that is sent."""
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (docs, real):
        sent = sorted(language_id.identify(df, held_out=language_id.mod4_is_2).collect(), key=repr)
        monkeypatch.setattr(language_id, "SENT_CELLS", 0)
        monkeypatch.setattr(language_id, "BLOCK_BYTES", 20000)
        apart = sorted(language_id.identify(df, held_out=language_id.mod4_is_2).collect(), key=repr)
        monkeypatch.undo()
        assert len(sent) == len(apart) == df.count()
        key = lambda r: (repr(r["doc_id"]), r["lang_pred"], round(r["entropy"], 3))
        for a, b in zip(sorted(sent, key=key), sorted(apart, key=key), strict=True):
            assert (a["doc_id"], a["held_out"], a["lang_pred"], a["rejected"]) == (b["doc_id"], b["held_out"], b["lang_pred"], b["rejected"])
            assert abs(a["score"] - b["score"]) < 1e-3 and abs(a["entropy"] - b["entropy"]) < 1e-4


def test_probabilities_sum_to_one():
    """After a known context, the seen letters and one unseen letter share all probability."""
    import pyarrow as pa

    text = pa.array(["the cat sat on the mat and the dog ate the hat"])
    grams, n = np.unique(language_id.Chars(text).grams(), return_counts=True)
    model = language_id.Model({"en": (grams, n)})
    letters = [*np.unique(grams & np.uint64(0xFFFF)), np.uint64(ord("q"))]
    one = language_id.Chars(pa.array([""]))
    one.n, one.first = np.array([1]), np.array([0, 1])
    for head in np.unique(grams >> np.uint64(16)):
        total = 0.0
        for x in letters:
            one.grams = lambda g=(head << np.uint64(16)) | x: np.array([g], np.uint64)
            total += float(np.exp(-model.entropies(one)[0, 0]))
        assert abs(total - 1) < 1e-4


def test_toxicity(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    out = toxicity.toxicity(docs, labels, held_out=toxicity.mod3_is_1).join(labels, "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    toxic, clean = [r for r in held if r["toxic"] == 1], [r for r in held if r["toxic"] == 0]
    assert np.mean([r["predicted"] for r in clean]) < 0.03
    assert np.mean([r["score"] for r in toxic]) > 0.5 + np.mean([r["score"] for r in clean])


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (None, 1), (2, None), (999, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    empty = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(empty) == len(ROWS) and {r["predicted"] for r in empty} == {0}
    assert toxicity.clean_rows(docs, labels.limit(0)).columns == docs.columns


def test_isotonic():
    x, p = toxicity.isotonic(np.array([0.1, 0.4, 0.3, 0.9, 0.8]), np.array([0.0, 1, 0, 1, 0]))
    assert (np.diff(x) >= 0).all() and (np.diff(p) >= 0).all()


EMPTY = [
    ("run_index", run_index.repeated_bytes), ("difference_cover", difference_cover.repeated_windows), ("token_counts", token_counts.token_counts), ("exact", exact_dedup.exact_duplicates),
    ("jaccard", jaccard_join.jaccard_components), ("one_of_each", jaccard_join.one_of_each), ("mix", mixing.mix), ("language", language_id.identify), ("tokens", lambda d: token_output.read_documents(token_output.write_frames(d))),
]


@pytest.mark.parametrize("name,f", EMPTY)
def test_empty_tables(none, name, f):
    assert f(none).collect() == []


def test_empty_tables_of_two(spark, docs, none):
    items, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert decontamination.contamination(none, spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []
    assert all(r["n_hit"] == 0 for r in decontamination.contamination(docs, items).collect())
    assert toxicity.toxicity(none, labels).collect() == []


def test_only_null_texts(spark):
    df = spark.createDataFrame([(1, None, None, None, None), (2, None, None, None, None)], H.SCHEMA)
    assert {r["n_removed"] for r in run_index.repeated_bytes(df).collect()} == {0}
    assert {r["n_removed"] for r in difference_cover.repeated_windows(df).collect()} == {0}
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()} == {(1, 1), (2, 2)}
    assert {r["keep_id"] for r in exact_dedup.exact_duplicates(df).collect()} == {1}
    assert len(mixing.mix(df).select("doc_id").distinct().collect()) <= 2
    assert {r["lang_pred"] for r in language_id.identify(df).collect()} == {"und"}
