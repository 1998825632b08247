"""Registered queries against their SQL, and the pipeline's stages against brute-force versions."""

from __future__ import annotations

import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import helpers as H
from conftest import same

import corpus_pipeline
from quillspark.llm import _bpe, mixing, queries, token_output, toxicity


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    same(queries.QUERIES[name](spark, sf_dir), *duck(sf_dir, queries.SQL[name]))


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """sf0.001 with some rows more: near copies, a null text, a repeated row."""
    at = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = docs.where("doc_id = 7").first()["text"]
    near = spark.createDataFrame([(5000 + k, base + f" tail{k}" * k, "en", "src1", 9) for k in range(4)] + [(5010, None, None, None, None), (5011, "", "en", "src1", 0)], H.SCHEMA)
    docs.unionByName(near).unionByName(docs.where("doc_id = 7")).write.parquet(f"{at}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{at}/{t}.parquet")
    return str(at)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, folder)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got[name] = (before, [tuple(r) for r in docs.collect()])
    key = lambda rows: sorted(rows, key=str)

    before, after = got["toxicity"]
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), held_out=toxicity.mod3_is_1)
    score = [H.plain_score(model, r[1]) for r in before]
    assert key(after) == key(r for r, s in zip(before, score, strict=True) if s < toxicity.THRESHOLD)

    before, after = got["jaccard_join"]
    roots = {c for _, _, c in H.brute_jaccard(before)}
    assert sorted(r[0] for r in after) == sorted(roots) and set(after) <= set(before)

    before, after = got["decontamination"]
    hit = H.brute_contamination(before, items)
    assert key(after) == key(r for r, h in zip(before, hit, strict=True) if not h[-1])

    before, after = got["mixing"]
    assert key(after) == key(H.brute_mix(before, mixing.TEMPERATURE, mixing.SEED)) and len(set(after)) < len(after)

    before, after = got["token_output"]
    t, want = _bpe.tokenizer(token_output.PATH), []
    for r in before:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.append((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert key((i, n, c) for i, _, n, c in after) == key(want)
    # in one unbroken order, which is not that of ids: copies of a document lie apart
    after = sorted(after, key=lambda r: r[1])
    assert [r[1] for r in after] == np.cumsum([0] + [r[2] for r in after][:-1]).tolist()
    side_by_side = sum(a[0] == b[0] for a, b in zip(after, after[1:], strict=False))
    copies = len(after) - len({r[0] for r in after})
    assert copies > 20 and side_by_side < copies / 5


def test_stages_with_hard_rows(spark, folder, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns; then tables without rows."""
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = H.corpus() + [(900, "some words, then " + items[0][1], "en", "s1", 0)]
    docs = H.with_clashes(spark.createDataFrame(rows, H.SCHEMA).repartition(3))
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r)[:5] for r in docs.collect()]
        out = stage(spark, docs, folder)
        after = [tuple(r)[:5] for r in out.collect()]
        if name == "token_output":
            assert len(after) == len(before)
            continue
        assert out.columns == docs.columns and out.where("block <> 7 OR mix_key <> 7").count() == 0
        if name == "jaccard_join":
            roots = {c for i, _, c in H.brute_jaccard(before) if i is not None}
            assert sorted(r[0] for r in after if r[0] is not None) == sorted(roots)
        if name == "decontamination":
            assert sorted(after, key=str) == sorted((r for r, h in zip(before, H.brute_contamination(before, items), strict=True) if not h[-1]), key=str) and 900 not in {r[0] for r in after}
        if name == "mixing":
            assert sorted(after, key=str) == sorted(H.brute_mix(before, mixing.TEMPERATURE, mixing.SEED), key=str)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    empty = spark.createDataFrame([], H.SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == []
    none = str(tmp_path / "none")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{none}/{t}.parquet")
    plain = spark.createDataFrame(rows, H.SCHEMA)
    for name, stage in (corpus_pipeline.STAGES[0], corpus_pipeline.STAGES[2]):
        assert stage(spark, plain, none).count() == len(rows), name


def test_toxicity_scores_equal_plain_python(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels, held_out=toxicity.mod3_is_1)
    text = {}
    for r in docs.collect():
        text.setdefault(r["doc_id"], set()).add(r["text"])
    odd = ["", "YOU !!?! sh1t $top *** aaargh", "Tú é€ 12a a1b \U0001f600x you", "x" * 5000]
    assert np.allclose(model.scores(pa.array(odd)), [H.plain_score(model, t) for t in odd], atol=1e-9)
    got = toxicity.toxicity(docs, labels, held_out=toxicity.mod3_is_1).collect()
    assert len(got) == docs.count()
    for r in got:
        assert any(abs(r["score"] - H.plain_score(model, t)) < 1e-9 for t in text[r["doc_id"]])
    # the fixture is too small for scores of THRESHOLD: rows go at a lower one
    low = float(np.quantile([r["score"] for r in got], 0.8))
    kept = toxicity.clean_rows(docs, labels, threshold=low, held_out=toxicity.mod3_is_1).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in docs.collect() if H.plain_score(model, r["text"]) < low) and len(kept) < len(got)


def test_run_applies_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    rows = out.collect()
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and rows
    ends = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))


def test_counts_follow_the_poisson_distribution():
    steps = mixing.poisson_steps(1.3)
    assert abs(steps[0] - np.exp(-1.3)) < 1e-12 and steps[-1] > 1 - 1e-15
    u = (np.arange(100_000) + 0.5) / 100_000
    assert abs(np.searchsorted(steps, u, side="right").mean() - 1.3) < 1e-3
