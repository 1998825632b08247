"""Journal pages and registry records."""

from __future__ import annotations

import pytest

from quillspark.operators import registries
from quillspark.sources import journal_pages as J
from quillspark.sources import pages

ARCHIVE = """<div class="obj_issue_summary"><a class="title" href="https://x/j/issue/view/7">Vol <b>1</b></a><div class="series">S</div><div class="description"><p>D</p></div></div>
<div class="obj_issue_summary"><span>no link</span></div><div class="obj_issue_summary"><a class="title" href="https://x/j/article/view/7">No</a></div>"""
TOC = """<div class="obj_issue_toc"><div class="heading"><div class="published"><span class="value">2025-01-02</span></div><div class="description">late</div></div><div class="sections">
<div class="section"><h2>Full</h2><div class="obj_article_summary"><div class="title"><a href="https://x/j/article/view/a1">A</a></div></div></div><div class="section"><h2>None</h2></div></div></div>"""
ARTICLE = """<article class="obj_article_details"><h1 class="page_title">T &amp; U</h1><h2 class="subtitle">Sub</h2><section class="item authors"><ul class="authors"><li><span class="name">Ann</span><span class="affiliation">X</span>
<span class="orcid"><a href=" https://orcid.org/1 ">o</a></span></li><li><span class="name">Bob</span></li></ul></section><section class="item doi"><span class="value"><a href="https://doi.org/10.1/a">d</a></span></section>
<section class="item keywords"><span class="value">one, two, ,three</span></section><section class="item abstract"><h2>Abstract</h2><p>Text</p></section><a href="https://x/citationstylelanguage/download/bibtex?submissionId=55&amp;x=1">b</a>
<div class="item issue"><section class="sub_item"><h2>Section</h2><div class="value">Notes</div></section><ul class="categories"><li><a>C1</a></li></ul></div>
<div class="item galleys"><a class="obj_galley_link pdf" href="https://x/j/article/view/a1/9">PDF</a><a class="obj_galley_link" href="https://x/j/article/view/a1">bad</a></div></article>"""


SITE = J.Site("https://x/j", bases=("https://x/j-old",), known=frozenset({"about"}))


def test_issues():
    (issue,) = SITE.issue_summaries(ARCHIVE + '<div class="obj_issue_summary"><a class="title" href="https://other/j/issue/view/8">Foreign</a></div>')["issues"]
    assert issue == {"id": "7", "title": "Vol 1", "series": "S", "descriptionHtml": "<p>D</p>", "cover": "", "ojsUrl": "https://x/j/issue/view/7"}
    whole = SITE.with_toc(issue, TOC)
    assert whole["descriptionHtml"] == "<p>D</p>" and whole["datePublished"] == "2025-01-02" and whole["sections"] == [{"title": "Full", "articles": ["a1"]}]
    assert SITE.with_toc(issue, "<p>broken</p>")["sections"] == []
    assert SITE.with_toc({**issue, "descriptionHtml": ""}, TOC)["descriptionHtml"] == "late"


def test_article(spark):
    df = spark.createDataFrame([("a1", ARTICLE), ("a2", "<p>nothing</p>")], "urlPath string, html string")
    out = {r["urlPath"]: r for r in pages.scraped(df, "urlPath", "html", SITE.article_record, J.ARTICLE, ("urlPath",)).collect()}
    a = out["a1"]
    assert (a["title"], a["subtitle"], a["doi"], a["submissionId"], a["section"]) == ("T & U", "Sub", "10.1/a", "55", "Notes")
    assert [(x["name"], x["affiliation"], x["orcid"]) for x in a["authors"]] == [("Ann", "X", "https://orcid.org/1"), ("Bob", "", "")]
    assert list(a["keywords"]) == ["one", "two", "three"] and a["abstractHtml"] == "<p>Text</p>" and list(a["categories"]) == ["C1"]
    assert [tuple(g) for g in a["galleys"]] == [("PDF", True, "https://x/j/article/view/a1/9", "https://x/j/article/download/a1/9", "a1-9.pdf")]
    assert a["ojsUrl"] == "https://x/j/article/view/a1" and a["bibtexUrl"].endswith("submissionId=55&x=1") and a["risUrl"] == ""
    assert out["a2"]["error"] == "Missing: no article" and out["a2"]["title"] is None


def test_the_last_citation_link_names_the_submission():
    link = '<a href="https://x/citationstylelanguage/download/{}?submissionId={}">c</a>'
    got = SITE.article_record('<article class="obj_article_details">' + link.format("ris", 2) + link.format("bibtex", 1) + "</article>")
    assert got["submissionId"] == "2" and got["risUrl"].endswith("=2")


def test_announcements():
    got = SITE.announcement_record('<div class="obj_announcement_full"><span class="date">d</span></div>', "3", "From the list")
    assert got == {"title": "From the list", "date": "d", "html": "", "ojsUrl": "https://x/j/announcement/view/3"}
    with pytest.raises(J.Missing):
        SITE.announcement_record("<p/>")
    one = '<div class="obj_announcement_summary"><a href="{}">T</a></div>'
    listed = "".join(one.format(h) for h in ("https://x/j/announcement/view/5", "https://x/j/announcement/view/x", "https://y/announcement/view/6")) + '<div class="obj_announcement_summary">none</div>'
    assert SITE.announcement_list(listed) == {"items": [{"id": "5", "title": "T"}]}


def test_page_and_journal():
    page = '<div class="pkp_structure_main"><div class="page"><nav class="cmp_breadcrumbs">c</nav><h1>T</h1><main><a href="/j/about">x</a></main><h1>second</h1></div></div>'
    assert SITE.page_record(page, "p") == {"title": "T", "html": '<div><a href="__BASE__about/">x</a></div><h1>second</h1>', "sourceUrl": "https://x/j/p"}
    with pytest.raises(J.Missing):
        SITE.page_record("<p>x</p>", "p")
    home = """<head><meta property="og:title" content="N"><meta name="description" content=" d "><link rel="icon" href="/f.ico"></head><div class="pkp_site_name"><img src="l.png"></div><ul id="navigationPrimary"><li><a href="https://x/j/team">Team</a>
    <a href="https://other/">O</a><a href="https://x/j/login">Login</a><a href="https://x/j/empty"></a></li></ul><div class="pkp_structure_sidebar"><div class="pkp_block block_custom" id="b1"><h2 class="pkp_screen_reader">S</h2><div class="content"><a href="https://x/j/team">t</a></div></div>
    <div class="pkp_block block_custom" id="b2"><h2>No content</h2></div><div class="pkp_block"><div class="content">not custom</div></div></div><div class="additional_content"><p>H</p></div><div class="pkp_footer_content">ISSN: 1234-567X</div>"""
    j = SITE.journal_record(home)
    assert (j["name"], j["description"], j["keywords"], j["issn"]) == ("N", "d", "", "1234-567X")
    assert j["nav"] == [{"label": "Team", "path": "team"}, {"label": "Login", "path": "login"}] and j["homepageHtml"] == "<p>H</p>" and j["footerHtml"] == "ISSN: 1234-567X"
    assert j["sidebarBlocks"] == [{"id": "b1", "title": "S", "titleHidden": True, "html": '<a href="__BASE__team/">t</a>'}]
    assert j["logo"].startswith("__BASE__assets/img/") and j["logo"].endswith("-l.png") and j["favicon"].endswith("-f.ico")
    assert J.mirrored_paths(["team", "login", "issue/x", "team"]) == ["team", "legal-disclosure"]


def test_site_routes():
    to = {"": "__BASE__", "article/view/a/9": "__BASE__articles/a/", "issue/view/1": "__BASE__issues/1/", "issue/view/1/2": None, "issue/current": "__BASE__issues/", "announcement/view/2": "__BASE__announcements/2/", "announcement": "__BASE__announcements/", "about?x#y": "__BASE__about/", "else": None}
    for path, want in to.items():
        for base in ("https://x/j", "https://x/j-old"):
            assert SITE.route(f"{base}/{path}") == (want or f"{base}/{path}")
    assert SITE.route("https://x/journal") == "https://x/journal"
    assert SITE.image("data:x", "") == "data:x" and J.Site("https://x", images={"https://x/a.png": "https://x/a.png"}).image("/a.png", "https://x/p") == "https://x/a.png"


def test_team():
    page = "<p>before</p><ul><li>nobody</li></ul><p><strong>A</strong></p><ul><li>Ann (X): r</li><li>Bob</li></ul><p>note <b>x</b></p><p> <strong>B</strong><br/>We <i>thank</i> you</p><p><strong>Empty</strong></p>"
    assert J.team_sections(page)["sections"] == [
        {"title": "A", "members": ["Ann (X): r", "Bob"], "hasPhotos": True, "noteHtml": "<p>note <b>x</b></p>"}, {"title": "B", "members": [], "hasPhotos": False, "noteHtml": "<p> We <i>thank</i> you</p>"},
    ]


def test_guide():
    assert J.guide_rows("<p>before</p><h2>A</h2><p>x</p>t<h2>B</h2>") == [(0, "A", "<p>x</p>t"), (1, "B", "")]
    assert J.guide_rows("<p>none</p>") == []


def test_fragments():
    got = J.clean_fragment('<main><a href="/j/about">x</a><img src="i.png" srcset="y"></main>', "https://x/p/", lambda u: "R:" + u, lambda u, page: "I:" + page + u)
    assert got == '<div><a href="R:https://x/j/about">x</a><img src="I:https://x/p/i.png"></div>'
    page = '<div><button id="tab-pdf">P</button><button id="tab-html" class="t" aria-selected="false">H</button><div id="panel-pdf">p</div><div id="panel-html" hidden="">h</div></div>'
    assert J.strip_panel(page) == '<div><button id="tab-html" class="t is-active" aria-selected="true">H</button><div id="panel-html" class="is-active">h</div></div>'
    assert 'aria-selected="false"' in J.strip_panel('<button id="tab-html" aria-selected="false">H</button>')
    assert J.inline_images('<img src="/a.png"><img src="//h/b.png"><img src="/c.png">', {"/a.png": "data:x"}) == '<img src="data:x"><img src="//h/b.png"><img src="/c.png">'


def test_registries(spark):
    a = spark.createDataFrame([("1", ["A &amp;amp; B"], [("Ann", "Lee", None), (None, None, "x")], "<jats:p>t</jats:p>"), ("2", [], [], None)], "doi string, title array<string>, author array<struct<given:string,family:string,ORCID:string>>, abstract string")
    b = spark.createDataFrame(
        [("2", [("T2",)], [("Bo", "", "", [("ORCID", "o1"), ("ORCID", "o2")]), ("", "", "Group", None)], [("Methods", "m"), (" Abstract ", "x")])],
        "doi string, titles array<struct<title:string>>, creators array<struct<givenName:string,familyName:string,name:string,nameIdentifiers:array<struct<nameIdentifierScheme:string,nameIdentifier:string>>>>, descriptions array<struct<descriptionType:string,description:string>>",
    )
    keys = spark.createDataFrame([("1",), ("2",), ("2",), ("3",)], "doi string")
    out = {r["doi"]: r for r in registries.lookup(keys, registries.first_registry(a), registries.second_registry(b)).collect()}
    assert out["1"]["title"] == "A & B" and [x["name"] for x in out["1"]["authors"]] == ["Ann Lee"] and out["1"]["abstract"] == "<p>t</p>"
    assert [(x["name"], x["orcid"]) for x in out["2"]["authors"]] == [("Bo", "o1"), ("Group", "")] and out["2"]["abstract"] == "<p>x</p>" and out["3"]["title"] is None


@pytest.mark.parametrize("name", ["article_records", "cleaned_fragments", "guide_sections", "announcement_records"])
def test_pages_of_a_small_file_are_many_tasks(spark, tmp_path, name):
    """A table of one small file is one task of Spark's own; its pages must not be."""
    from pyspark.sql import functions as F

    from quillspark.plans import registry

    rows = spark.range(12_000).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "id AS c_custkey", "'c' AS c_name", "id % 5 AS c_nationkey")
    for table in ("part", "customer"):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    each = [r["count"] for r in registry.QUERIES[name](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert len(each) == 3 and max(each) < 2 * sum(each) / 3
