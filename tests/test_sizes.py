"""How queries that make much of small files are dealt out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.operators import layout
from quillspark.plans import registry


@pytest.mark.parametrize("name", ["layout_classes", "layout_figures", "layout_full_text", "layout_standalone"])
def test_no_guessed_size_is_broadcast(spark, sf_dir, name):
    """Spark guesses the size of what is made of a small file from the file, so it would broadcast any number of blocks."""
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["layout_blocks", "layout_footnote_markers"])
def test_blocks_of_a_small_file_are_many_tasks(spark, tmp_path, name):
    """Blocks are grouped in the tasks that their documents were dealt to, in one pass over the spans."""
    spark.range(12_000).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = registry.QUERIES[name](spark, str(tmp_path))
    each = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(each) == 3 and max(each) < 2 * sum(each) / 3
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == (2 if name == "layout_footnote_markers" else 1)


def test_block_rows_of_odd_spans(spark):
    """Ties of style go to the first span; no text, no style; a block without a key is none."""
    names = "doc string, page int, block int, block_type int, line int, span int, text string, size double, flags int, font string"
    row = lambda doc, block, line, span, text, size=10.0, flags=0, kind=0, font="Serif": (doc, 0, block, kind, line, span, text, size, flags, font)
    data = [
        row("d", 1, 1, 0, "cd", 9.0), row("d", 1, 0, 1, "b-", 12.0, 16), row("d", 1, 0, 0, "a", 10.0), row("d", 2, 0, 0, " "), row("d", 3, 0, 0, None), row("d", 4, 0, 0, "xy", None, None, font="CMMI10"),
        row(None, 1, 0, 0, "no"), row("d", None, 0, 0, "no"), row("d", 5, 0, 0, "image", kind=1), row("e", 1, 0, 0, "x", 8.0, kind=1),
    ]
    spans = spark.createDataFrame(data, names).selectExpr("*", *[f"{v}D AS {c}" for c, v in (("page_w", 600), ("page_h", 800), ("x0", 0), ("y0", 0), ("x1", 1), ("y1", 1))])
    out = sorted(tuple(r) for r in layout.block_rows(spans).selectExpr("doc", "block", "text", "size", "bold", "math_share", "lead.text").collect())
    assert [r[:6] for r in out] == [("d", 1, "abcd", 12.0, True, 0.0), ("d", 2, "", 0.0, False, 0.0), ("d", 3, "", 0.0, False, 0.0), ("d", 4, "xy", 0.0, False, 1.0)]
    assert out[0][6] == "a"
    assert {r["doc"]: r["body"] for r in layout.body_size(spans).collect()} == {"d": 10.0, "e": 11.0, None: 11.0}
