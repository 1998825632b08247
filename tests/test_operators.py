"""Relational operators, folds, layout and citations on small rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.operators import citations, joins, layout, search, sections, series, site
from quillspark.streaming import incremental


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def test_keep_first_and_last_ignore_input_order(spark):
    data = [("a", i, f"v{i}") for i in range(20)] + [("b", 3, None)]
    for n in (1, 7):
        df = spark.createDataFrame(data[::-1], "k string, ord int, v string").repartition(n)
        assert sorted(rows(joins.keep_last(df, ["k"], ["ord"]))) == [("a", 19, "v19"), ("b", 3, None)]
        assert sorted(rows(joins.keep_first(df, ["k"], ["ord"]), "k", "ord")) == [("a", 0), ("b", 3)]


def test_left_default_never_matches_an_empty_key(spark):
    left = spark.createDataFrame([("", 1), (None, 2), ("x", 3), ("y", 4)], "k string, n int")
    right = spark.createDataFrame([("", 10), ("x", 20)], "k string, v int")
    assert sorted(rows(joins.left_default(left, right, "k", {"v": 0}), "n", "v")) == [(1, 0), (2, 0), (3, 20), (4, 0)]


def test_outer_series_and_maps(spark):
    a, b = spark.createDataFrame([("x", "2025-01", 1)], "k string, ym string, value long"), spark.createDataFrame([("x", "2025-01", 2), ("x", "2025-02", 5)], "k string, ym string, value long")
    assert sorted(rows(joins.outer_series(a, b, ["k", "ym"]))) == [("x", "2025-01", 3), ("x", "2025-02", 5)]
    m = spark.createDataFrame([({"a": 1}, {"a": 2, "b": 3})], "x map<string,bigint>, y map<string,bigint>").select(joins.merge_maps(F.col("x"), F.col("y")).alias("m"))
    assert m.first()["m"] == {"a": 3, "b": 3}


def test_timeline_skips_what_it_cannot_read(spark):
    df = spark.createDataFrame([("1", "2025-11-01", "", "3"), ("1", "", "2025-11", " 4 "), ("1", "2025-12", "", "3.5"), ("1", "2025-12", "", None), ("1", "bad", "", "1"), ("1", None, "2026-01-05", "7"), ("1", "2025-11-09", "2020-01", "x")], "id string, date string, label string, value string")
    assert sorted(rows(series.monthly_timeline(df, ["id"]))) == [("1", "2025-11", 7), ("1", "2026-01", 7)]
    floats = spark.createDataFrame([("1", "2025-11", "", 3.9)], "id string, date string, label string, value double")
    assert rows(series.monthly_timeline(floats, ["id"])) == [("1", "2025-11", 3)]


def test_funnel_counts_null_as_under_review(spark):
    df = spark.createDataFrame([(1, 3), (2, 4), (3, None), (4, 1), (5, 3), (6, 5)], "id int, status int")
    kept = series.exclude(df, "id", spark.createDataFrame([(5,)], "x int"))
    counts = series.funnel_status(kept, F.col("status"), 3, 4)
    assert rows(counts) == [(1, 3, 1, 5)]
    assert [r[1:3] for r in rows(series.shares(counts, ["published", "underReview", "declined"]))] == [("published", 1), ("underReview", 3), ("declined", 1)]
    empty = series.funnel_status(df.limit(0), F.col("status"), 3, 4)
    assert rows(empty) == [(0, 0, 0, 0)] and rows(series.shares(empty, ["published", "underReview", "declined"])) == []


def test_views_total_is_null_only_if_both_are(spark):
    df = spark.createDataFrame([(1, 2), (None, 2), (1, None), (None, None), (0, None)], "a int, b int")
    assert [r[0] for r in rows(df.select(series.views_total(F.col("a"), F.col("b"))))] == [3, 2, 1, None, 0]
    assert rows(df.select(series.views_breakdown(F.col("a"), F.col("b"), "x", "y")))[0][0] == "1 x · 2 y"


def test_hits_rollup_keeps_keys_without_hits(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    hits = spark.createDataFrame([("a", "2025-01", 2), ("a", "2025-02", 0), ("c", "2025-01", 9)], "k string, ym string, count long")
    r = series.hits_rollup(keys, hits, "k")
    assert sorted(rows(r)) == [("a", 2, {"2025-01": 2}), ("b", 0, {})]
    assert rows(series.coverage(r)) == [(1, 2)]


def test_min_month_without_a_start_keeps_all(spark):
    p = spark.createDataFrame([("a", "2025-01", 1), ("a", "2025-03", 2), ("b", "2024-01", 3)], "k string, ym string, value long")
    assert sorted(rows(series.from_month(p, spark.createDataFrame([("a", "2025-02"), ("b", None)], "k string, start_ym string"), "k"), "value")) == [(2,), (3,)]


def test_facets(spark):
    index = spark.createDataFrame(
        [("Red Box", "", ["Ann"], "S1", ["c1"], 2020, "2020-05", 0), ("Blue", "red", [], "", [], None, "", 1), ("x", "", ["Red"], "S2", ["c2"], 2022, "2022-01", 2), ("Red Box", "", [], "S1", ["c1"], 2020, "2020-05", 3)],
        "title string, subtitle string, authors array<string>, section string, categories array<string>, year int, date string, ord long",
    )
    found = lambda **k: [r["ord"] for r in search.facet_search(index, **k).collect()]
    assert found(q=" RED ") == [2, 0, 3, 1] and found(q="box  ann") == [0] and found() == [2, 0, 3, 1]
    assert found(sections=["S1"]) == [0, 3] and found(sections=["S1"], n_sections=1) == [2, 0, 3, 1] and found(sections=[], n_sections=0) == [2, 0, 3, 1]
    assert found(categories=["c2"]) == [2, 1] and found(categories=[], n_categories=2) == [1] and found(years=(2021, 2019)) == [0, 3, 1]
    o = search.facet_options(index).first()
    assert (o["sections"], o["categories"], o["yearMin"], o["yearMax"]) == (["S1", "S2"], ["c1", "c2"], 2020, 2022)
    now = search.facet_options(index.limit(0)).first()
    assert now["yearMin"] == now["yearMax"] and now["sections"] == []


def test_unique_slugs_look_at_all_used_ones(spark):
    df = spark.createDataFrame([("d", i, s) for i, s in enumerate(["a", "a", "a-2", "a", "", "a-2"])], "doc string, ord int, slug string").repartition(3)
    assert [r["unique_slug"] for r in sections.unique_slugs(df, ["doc"], "ord", "slug").orderBy("ord").collect()] == ["a", "a-2", "a-2-2", "a-3", "section-4", "a-2-3"]


def test_unique_slugs_of_many_keys_pass_through_one_function(spark):
    """Keys in one task, a null one and one that is NaN included; rows of equal order are taken by slug."""
    df = spark.createDataFrame([(k, i, s) for k in (1.0, 2.0, None, float("nan")) for i, s in ((2, "a"), (1, "a"), (None, "a"), (2, "B"), (0, None))], "doc double, ord int, slug string").coalesce(1)
    out = sections.unique_slugs(df, ["doc"], "ord", "slug")
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    want = [(0, None, "section-0"), (1, "a", "a"), (2, "B", "B"), (2, "a", "a-2"), (None, "a", "a-3")]
    assert sorted(map(str, rows(out, "doc", "ord", "slug", "unique_slug"))) == sorted(str((k, *w)) for k in (1.0, 2.0, None, float("nan")) for w in want)


def test_team_sections(spark):
    from quillspark.sources.pages import team_rows

    page = "<p>before</p><p><strong>Editors</strong></p><ul><li>Ann (X)</li><li>Bob</li></ul><p><strong>Support</strong><br/>We thank.</p><p>More.</p><p><strong>Empty</strong></p>"
    data = [("t", i, *r) for i, r in enumerate(team_rows(page))]
    df = spark.createDataFrame(data, "doc string, ord int, kind string, opens boolean, title string, text string")
    s = sections.section_rows(df, ["doc"], "ord", F.col("opens"), F.col("title"), F.col("kind"), "text").orderBy("section").collect()
    assert [(r["title"], r["members"], r["note"]) for r in s] == [("Editors", ["Ann (X)", "Bob"], ""), ("Support", [], "We thank.More.")]


def test_citations(spark):
    refs = "<p>Dreber, A., &amp; Johannesson, M. (2025a). Title &lt;x&gt;.</p><p>Smith, J. (2020). A , b.</p><p>No year.</p><p>Lee, A., Kim, B., &amp; Poe, C. (2019). C.</p><p>OECD (2018). R.</p><p>Smith, J. (2020). Second.</p>"
    body = 'As Dreber &amp; Johannesson (2025a) and (Smith, 2020; Lee et al. 2019) say, <img alt="Smith 2020"> OECD 2018.'
    docs = spark.createDataFrame([("d", refs, body), ("e", "", body)], "doc string, refs string, body string")
    r = citations.reference_rows(docs, "doc", "refs")
    assert [(x["surnames"], x["year"]) for x in r.orderBy("ord").collect()] == [(["Dreber", "Johannesson"], "2025a"), (["Smith"], "2020"), (["Lee", "Kim", "Poe"], "2019"), (["OECD"], "2018"), (["Smith"], "2020")]
    forms = citations.surfaces(r, "doc")
    assert {f["surface"] for f in forms.collect()} >= {"Dreber &amp; Johannesson (2025a)", "Smith, 2020", "Lee et al. 2019", "OECD 2018"}
    assert forms.where("surface = 'Smith 2020'").first()["html"] == "Smith, J. (2020). A, b."
    out = {x["doc"]: x["body"] for x in citations.link_citations(docs, forms, "doc", "body").collect()}
    assert out["e"] == body and out["d"].count('class="cite-ref"') == 4 and '<img alt="Smith 2020">' in out["d"]


def test_link_takes_the_longest_form():
    forms = {"A 2020": "short", "A 2020b": "long"}
    assert citations.link("see A 2020b", forms) == 'see <span class="cite-ref" tabindex="0">A 2020b<span class="cite-tooltip">long</span></span>'


SPAN = "doc string, page int, page_w double, page_h double, block int, block_type int, line int, span int, text string, size double, flags int, font string, x0 double, y0 double, x1 double, y1 double"


def span(page, block, text, size=11.0, flags=0, font="Times", line=0, n=0, box=(50.0, 100.0, 550.0, 120.0)):
    return ("d", page, 600.0, 800.0, block, 0, line, n, text, size, flags, font, *box)


@pytest.fixture(scope="module")
def spans(spark):
    data = []
    for p in range(3):
        data += [span(p, 0, f"Journal of X | {p + 1}", 8.0), span(p, 9, str(p + 1), 8.0)]
    data += [
        span(0, 1, "Abstract text before the start."), span(0, 2, "Introduction", 14.0, 16), span(0, 3, "An exam-"), span(0, 3, "ple of text", line=1), span(0, 4, "1", 6.0, box=(50.0, 700.0, 550.0, 720.0)), span(0, 4, "A note.", 9.0, n=1, box=(50.0, 700.0, 550.0, 720.0)),
        span(1, 1, "Figure 1 A caption", box=(50.0, 500.0, 550.0, 520.0)), span(1, 2, "axis", 7.0, box=(200.0, 300.0, 220.0, 310.0)), span(1, 3, "x=y", 11.0, font="CMMI10", box=(50.0, 600.0, 550.0, 620.0)),
        span(2, 1, "References", 14.0, 16), span(2, 2, "Smith, J. (2020)."), span(2, 3, "Appendix", 14.0, 16), span(2, 4, "The end of all of it."),
    ]
    return spark.createDataFrame(data, SPAN)


def test_layout(spark, spans):
    images = spark.createDataFrame([("d", 1, 100.0, 200.0, 500.0, 450.0), ("d", 2, 10.0, 10.0, 300.0, 300.0), ("d", 2, 0.0, 0.0, 20.0, 20.0)], "doc string, page int, x0 double, y0 double, x1 double, y1 double")
    drawings, marks = images.limit(0), spark.createDataFrame([("d", 0, 1, "Introduction"), ("d", 1, 2, "Appendix")], "doc string, ord int, level int, title string")
    assert layout.body_size(spans).first()["body"] == 11.0
    blocks = layout.block_rows(spans)
    keys = layout.furniture(blocks)
    assert [r["key"] for r in keys.collect()] == ["journal of x"]
    assert rows(layout.footnote_markers(blocks, layout.body_size(spans))) == [("d", 0, ["1"])]
    figures = layout.figure_regions(blocks, images, drawings, keys)
    assert rows(figures, "page", "block", "x0", "y0", "x1", "y1") == [(1, 1, 96.0, 196.0, 504.0, 454.0)]
    assert rows(layout.standalone_images(images, figures), "page") == [(2,)]
    out = layout.classified(spans, images, drawings, marks).orderBy("ord").collect()
    assert [(r["page"], r["kind"], r["text"]) for r in out] == [
        (0, "heading", "Introduction"), (0, "paragraph", "An example of text"), (0, "footnote", "1A note."), (1, "figure", "Figure 1 A caption"), (1, "inside_figure", "axis"), (1, "equation", "x=y"), (2, "heading", "Appendix"), (2, "paragraph", "The end of all of it."),
    ]
    assert [r["figure_no"] for r in out if r["figure_no"]] == [1, 2] and [r["level"] for r in out if r["level"]] == [1, 2]
    whole = layout.classified(spans, images, drawings, marks.limit(0)).count()
    assert whole == len(out) + 1


def test_weighted_mode_takes_the_first_on_a_tie(spark):
    df = spark.createDataFrame([("k", "b", 2, 0), ("k", "a", 1, 1), ("k", "a", 1, 2)], "k string, v string, w int, ord int").repartition(3)
    assert rows(layout.weighted_mode(df, ["k"], F.col("v"), F.col("w"), F.col("ord"))) == [("k", "b", 2)]


def test_footnotes_resolve_to_the_last_body(spark):
    refs = spark.createDataFrame([("d", 0, "1"), ("d", 1, "1")], "doc string, page int, marker string")
    bodies = spark.createDataFrame([("d", 0, "1", 1, "old"), ("d", 0, "1", 2, "new")], "doc string, page int, marker string, ord int, text string")
    assert sorted(rows(layout.resolved_footnotes(refs, bodies), "page", "body"), key=str) == [(0, "new"), (1, None)]


SHEET = ["ID", "Stage website", "GDrive Folder", "First Author", "Preprint", "PubPeer Comments", "Lay Summary", "Handling Editor", "Submission Date", "Published DOI", "Peer Review Report", "Reproducibility Certificate", "Data", "Materials"]


def test_sheet(spark):
    def row(**k):
        return tuple(k.get(c) for c in SHEET)

    data = [
        row(**{"ID": "12", "Stage website": "In review", "GDrive Folder": "— 7 A study", "First Author": "Ann", "Preprint": "https://doi.org/10.1234/X", "Submission Date": "5.1.2026"}), row(**{"ID": "13", "Stage website": "Desk Reject"}), row(**{"ID": "x", "Stage website": "In review"}),
        row(**{"ID": "14", "Stage website": "Unpublished", "Submission Date": "soon"}), row(**{"Published DOI": "https://doi.org/10.1/A", "Data": "www.a.org"}), row(**{"Published DOI": "10.1/a", "Data": "www.b.org", "Materials": "-"}), row(**{"Published DOI": "10.1/b", "Data": "-"}),
    ]
    sheet = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], ", ".join(f"`{c}` string" for c in SHEET) + ", ord int")
    lookup = spark.createDataFrame([("10.1234/X", "Found", None, "abs")], "doi string, title string, authors array<struct<name:string,affiliation:string,orcid:string>>, abstract string")
    out = site.under_review(sheet, lookup).collect()
    assert [(r["id"], r["title"], r["submissionDate"]) for r in out] == [("14", "Untitled submission", "soon"), ("12", "Found", "2026-01-05")]
    assert out[1]["authors"][0]["name"] == "Ann" and out[0]["authors"] == [] and out[1]["prereviewUrl"].endswith("doi-10.1234-x/write-a-prereview")
    extras = site.published_extras(sheet, "ord").collect()
    assert [(r["doi"], r["dataUrl"], r["materialsUrl"]) for r in extras] == [("10.1/a", "https://www.b.org", "")]
    m = spark.createDataFrame(extras).select(site.materials().alias("m")).first()["m"]
    assert [(x["label"], x["url"]) for x in m] == [("Data", "https://www.b.org")]


def test_visible_blocks(spark):
    df = spark.createDataFrame([([("a", True), ("b", False), ("c", None)],)], "sidebarBlocks array<struct<id:string,titleHidden:boolean>>")
    assert [b["id"] for b in df.select(site.visible_blocks().alias("b")).first()["b"]] == ["b", "c"]


def test_stream_reads_each_file_once(spark, sf_dir, tmp_path):
    import shutil

    src, out, state = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    src.mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", src / "a.parquet")
    keys = ["day", "event_type"]
    incremental.ingest(spark, f"file://{src}", out, state)
    once = incremental.totals(spark, out, keys).agg(F.sum("n")).first()[0]
    incremental.ingest(spark, f"file://{src}", out, state)
    assert incremental.totals(spark, out, keys).agg(F.sum("n")).first()[0] == once == spark.read.parquet(f"file://{src}").count()
    shutil.copy(f"{sf_dir}/events.parquet", src / "b.parquet")
    incremental.ingest(spark, f"file://{src}", out, state)
    assert incremental.totals(spark, out, keys).agg(F.sum("n")).first()[0] == 2 * once
