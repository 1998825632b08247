"""Pages of a journal, made from the tables and scraped again: the records must give back what the pages were made from."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators.joins import merged
from quillspark.plans.tables import spread, table, tasks
from quillspark.sources import journal_pages as J
from quillspark.sources import pages

BASE = "https://x.example/j"
SITE = J.Site(BASE, known=frozenset({"about"}))


def _page(df, key, pattern, *columns):
    """(key, html): a page of each row; %s in the pattern are the columns."""
    return spread(df, key).select(F.col(key).cast("string").alias("key"), F.format_string(pattern, *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns]).alias("html"))


def _join(array, *fields):
    """Fields of an array of structs as one text."""
    return F.array_join(F.transform(array, lambda x: F.concat_ws("|", *[x[f].cast("string") for f in fields])), ";")


def journal_record(spark, sf_dir):
    """A home page for each nation; every second one without sidebar, title and identifiers."""
    n = table(spark, sf_dir, "nation")
    full = (
        '<head><meta property="og:title" content="%s"><meta name="description" content=" About %s "><meta name="keywords" content="a, b"><link rel="icon" href="/f%s.ico"></head><div class="pkp_site_name"><img src="logo.png"></div>'
        '<ul id="navigationPrimary"><li><a href="https://x.example/j/team">Our  team</a></li><li><a href="https://other.example/">Away</a></li><li><a href="https://x.example/j/login"></a></li><li><a href="https://x.example/j/issue/archive#x">Issues</a></li></ul>'
        '<div class="pkp_structure_sidebar"><div class="pkp_block block_custom" id="b"><h2 class="pkp_screen_reader">Side</h2><div class="content"><a href="https://x.example/j/team">t</a></div></div><div class="pkp_block block_custom"><h2>No content</h2></div></div>'
        '<div class="additional_content"><main><p>Home of %s</p></main></div><div class="pkp_footer_content">ISSN: 1234-567X <a href="/j/article/view/%s/9">a</a></div>'
    )
    rows = _page(n.where("n_nationkey % 2 = 0"), "n_nationkey", full, "n_name", "n_name", "n_nationkey", "n_name", "n_nationkey").unionByName(_page(n.where("n_nationkey % 2 = 1"), "n_nationkey", "<p>%s</p>", "n_name"))
    r = pages.scraped(rows, "key", "html", SITE.journal_record, J.JOURNAL)
    return r.select("key", "name", "description", "keywords", "issn", "submitUrl", "logo", "favicon", "homepageHtml", "footerHtml", _join(F.col("nav"), "label", "path").alias("nav"), _join(F.col("sidebarBlocks"), "id", "title", "titleHidden", "html").alias("blocks"))


def page_record(spark, sf_dir):
    """A page for each supplier; those of every fifth lack the container."""
    s = table(spark, sf_dir, "supplier")
    full = '<div class="pkp_structure_main"><div class="page"><nav class="cmp_breadcrumbs"><h1>crumb</h1></nav><h1>About <i>%s</i></h1><header><a href="/j/issue/view/%s">i</a> <a href="mailto:a@b">m</a></header><h1>2</h1></div></div>'
    rows = _page(s.where("s_suppkey % 5 > 0"), "s_suppkey", full, "s_name", "s_suppkey").unionByName(_page(s.where("s_suppkey % 5 = 0"), "s_suppkey", "<h1>%s</h1>", "s_name"))
    return pages.scraped(rows, "key", "html", SITE.page_record, J.PAGE, ("key",))


def issue_records(spark, sf_dir):
    """An archive page for each supplier key modulo 10: a link of another host and one to an article are no issues."""
    s = table(spark, sf_dir, "supplier")
    one = '<div class="obj_issue_summary"><a class="title" href="https://%s/view/%s">Vol <b>%s</b></a><div class="cover"><img src="c%s.jpg"></div><div class="series">S %s</div><div class="description"><a href="/j/about">d</a></div></div>'
    where = F.element_at(F.array(*map(F.lit, ["x.example/j/issue", "other.example/j/issue", "x.example/j/article", "x.example/j/issue"])), (F.col("s_suppkey") % 4 + 1).cast("int"))
    item = F.format_string(one, where, *[F.col("s_suppkey").cast("string")] * 2, F.col("s_nationkey").cast("string"), F.col("s_name"))
    archive = s.groupBy((F.col("s_suppkey") % 10).cast("string").alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", item.alias("i")))), lambda x: x["i"]), "").alias("html"))
    return pages.scraped(archive, "key", "html", SITE.issue_summaries, J.ISSUES).select("key", F.posexplode("issues").alias("pos", "i")).select("key", "pos", "i.*")


def issue_tocs(spark, sf_dir):
    """A table of contents for each nation: odd articles lead elsewhere, the second section has none; some pages are broken."""
    n = table(spark, sf_dir, "nation")
    toc = (
        '<div class="obj_issue_toc"><div class="heading"><div class="published"><span class="label">Published</span><span class="value">2024-01-%s</span></div><div class="description"><p>%s</p></div></div><div class="sections">'
        '<div class="section"><h2>Articles</h2><div class="obj_article_summary"><div class="title"><a href="https://x.example/j/article/view/a%s/7">A</a></div></div><div class="obj_article_summary"><div class="title"><a href="%s/j/article/view/b%s">B</a></div></div></div>'
        '<div class="section"><h2>Empty</h2><div class="obj_article_summary"><div class="title">none</div></div></div></div></div>'
    )
    host = F.when(F.col("n_nationkey") % 2 == 1, "https://y.example").otherwise("https://x.example")
    rows = _page(n.where("n_nationkey % 7 > 0"), "n_nationkey", toc, F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), "n_name", "n_nationkey", host, "n_nationkey").unionByName(_page(n.where("n_nationkey % 7 = 0"), "n_nationkey", "<p>%s</p>", "n_name"))
    r = pages.scraped(rows, "key", "html", SITE.issue_toc, J.TOC, ("key",))
    return r.select("key", "datePublished", "descriptionHtml", F.size("sections").alias("n_sections"), F.array_join(F.element_at("sections", 1)["articles"], ",").alias("articles"), F.element_at("sections", 1)["title"].alias("section"), "error")


def article_records(spark, sf_dir):
    """An article for each part, with one author or two, with and without DOI, galley of PDF or text."""
    p = table(spark, sf_dir, "part")
    k, odd = F.col("p_partkey").cast("string"), F.col("p_partkey") % 2 == 1
    second = F.when(odd, '<li><span class="name">Second</span></li>').otherwise("")
    doi = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('<section class="item doi"><span class="value"><a href=" https://doi.org/10.1/'), k, F.lit('">d</a></span></section>'))).otherwise("")
    label = F.when(odd, "PDF").otherwise("Text")
    html = (
        '<article class="obj_article_details"><h1 class="page_title">On %s</h1><h2 class="subtitle">Sub</h2><section class="item authors"><ul class="authors"><li><span class="name">Ann %s</span><span class="affiliation">X , Y</span><span class="orcid"><a href="https://orcid.org/%s">o</a></span></li>%s</ul></section>%s'
        '<section class="item keywords"><span class="value">%s, ,two</span></section><section class="item abstract"><h2>Abstract</h2><p>Text of %s</p></section><div class="item references"><div class="value"><p><a href="/j/article/view/z">r</a></p></div></div><div class="item published"><span class="value">2024-02-03</span></div>'
        '<div id="citationOutput"><div class="csl-entry">Ann <span>(2024)</span> .</div></div><a href="https://x.example/j/citationstylelanguage/download/ris?submissionId=9%s">r</a><a href="https://x.example/j/citationstylelanguage/download/bibtex?submissionId=8%s">b</a>'
        '<div class="item issue"><section class="sub_item"><h2>Issue</h2><div class="value">no</div></section><section class="sub_item"><h2>Section</h2><div class="value">%s</div></section><ul class="categories"><li><a>C1</a></li><li><a>C2</a></li></ul></div>'
        '<div class="item copyright"><h2>License</h2><p>CC</p></div><div class="item galleys"><a class="obj_galley_link" href="https://x.example/j/article/view/%s/3">%s</a><a class="obj_galley_link pdf" href="https://x.example/j/article/view/no">bad</a></div></article>'
    )
    rows = _page(p, "p_partkey", html, "p_name", k, k, second, doi, "p_brand", "p_name", k, k, "p_type", k, label)
    r = pages.scraped(rows, "key", "html", SITE.article_record, J.ARTICLE, ("key",))
    return r.select(
        "key", "title", "subtitle", "datePublished", "citation", _join(F.col("authors"), "name", "affiliation", "orcid").alias("authors"), "doi", F.array_join("keywords", ",").alias("keywords"), "abstractHtml", "referencesHtml", "licenseHtml", "submissionId", "bibtexUrl",
        "risUrl", "section", F.array_join("categories", ",").alias("categories"), _join(F.col("galleys"), "label", "isPdf", "viewUrl", "downloadUrl", "localPdf").alias("galleys"), "ojsUrl",
    )


def team_sections(spark, sf_dir):
    """A team page for each nation with two members, a note, and a section of prose."""
    n = table(spark, sf_dir, "nation")
    html = "<p>before</p><ul><li>nobody</li></ul><p><strong>Editors of %s</strong></p>\n<ul><li>Ann <b>%s</b> (X): chief</li><li>Bob</li></ul><p>A <i>note</i></p><p><strong>Support</strong><br>We thank %s</p><p><strong>Empty</strong></p>"
    r = pages.scraped(_page(n, "n_nationkey", html, "n_name", "n_name", "n_name"), "key", "html", J.team_sections, J.TEAM)
    return r.select("key", F.posexplode("sections").alias("pos", "s")).select("key", "pos", "s.title", F.array_join("s.members", ";").alias("members"), "s.hasPhotos", "s.noteHtml")


def announcement_records(spark, sf_dir):
    """Announcements of each customer's list page with what their own pages say; some have no heading, some no body."""
    k = F.col("c_custkey").cast("string")
    c = table(spark, sf_dir, "customer").withColumn("key", k)
    n = tasks(c)
    c = c.repartition(n, "key")
    where = F.element_at(F.array(*map(F.lit, ["https://x.example/j/announcement/view/%s", "https://x.example/j/announcement/view/x%s", "https://y.example/announcement/view/%s"])), (F.col("c_custkey") % 3 + 1).cast("int"))
    listed = c.select("key", "c_name", "c_nationkey", F.concat(F.lit('<div class="obj_announcement_summary"><a href="'), F.replace(where, F.lit("%s"), k), F.lit('">About '), "c_name", F.lit("</a></div>")).alias("html"))
    items = pages.scraped(listed, "key", "html", SITE.announcement_list, J.ANNOUNCEMENTS).select(F.explode("items").alias("i")).select(F.col("i.id").alias("key"), F.col("i.title").alias("listed"))
    head, body = F.when(F.col("c_nationkey") % 2 == 0, "<h1>News</h1>").otherwise(""), F.when(F.col("c_nationkey") % 3 > 0, '<div class="description"><p>Body</p></div>').otherwise("")
    own = listed.select("key", F.concat(F.lit('<div class="obj_announcement_full">'), head, F.lit('<div class="date">2024-05-06</div>'), body, F.lit("</div>")).alias("html"))
    return pages.scraped(items.repartition(n, "key").join(merged(own), "key"), "key", "html", SITE.announcement_record, J.ANNOUNCEMENT, ("key", "listed"))


def guide_sections(spark, sf_dir):
    """Guides of two headings; what precedes the first belongs to none, a link in it is kept as it is."""
    p = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.format_string("<p>before</p><h2>For %s</h2><p>x</p>tail<h2>About</h2><ul><li>%s</li></ul>", "p_name", "p_brand").alias("html"))
    r = pages.scraped(p, "p_partkey", "html", lambda t: {"rows": [{"ord": i, "heading": h, "html": x} for i, h, x in J.guide_rows(t)]}, "rows ARRAY<STRUCT<ord: INT, heading: STRING, html: STRING>>")
    return r.select("p_partkey", F.explode("rows").alias("r")).select("p_partkey", "r.*")


def discovered_pages(spark, sf_dir):
    """First segments of the pages' paths in the order of their first page, without two exclusions and a prefix, and extras."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.element_at(F.split("url", "/"), 4).alias("path"))
    return pages.discovered(p, "ord", "path", ["en"], ["f"], ["de", "legal-disclosure"])


def cleaned_fragments(spark, sf_dir):
    """Fragments with landmarks, links of every kind and an image with a source set."""
    p = table(spark, sf_dir, "part")
    html = '<main><header>%s</header><a href="article/view/%s/1">a</a><a href="/j/issue/current">i</a><a href="https://y.example/">y</a><img src="/i/%s x.png" srcset="z"></main>'
    r = pages.scraped(_page(p, "p_partkey", html, "p_name", "p_partkey", "p_partkey"), "key", "html", lambda t: {"clean": SITE.clean(pages.tree(t), BASE + "/")}, "clean STRING")
    return r.select("key", "clean")


def view_panels(spark, sf_dir):
    """Pages with two views, of which the PDF goes, and pages without that view; images as data URIs where there is one."""
    n = table(spark, sf_dir, "nation")
    tabs = '<div><button id="tab-pdf" class="is-active">P</button><button id="tab-html" class="t" aria-selected="false">H</button>%s<div id="panel-html" hidden=""><img src="/a.png"><img src="//h/b.png"><img src="/c.png">%s</div></div>'
    panel = F.when(F.col("n_nationkey") % 2 == 0, '<div id="panel-pdf">p</div>').otherwise("")
    r = pages.scraped(_page(n, "n_nationkey", tabs, panel, "n_name"), "key", "html", lambda t: {"view": J.inline_images(J.strip_panel(t), {"/a.png": "data:image/png;base64,AA=="})}, "view STRING")
    return r.select("key", "view")


QUERIES = {f.__name__: f for f in (journal_record, page_record, issue_records, issue_tocs, article_records, team_sections, announcement_records, guide_sections, discovered_pages, cleaned_fragments, view_panels)}
_IMG = lambda url, name: f"'__BASE__assets/img/' || substr(sha1({url}), 1, 8) || '-' || {name}"
SQL = {
    "journal_record": f"""SELECT n_nationkey::VARCHAR AS key, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Replication Research' END AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'About ' || n_name ELSE '' END AS description, CASE WHEN n_nationkey % 2 = 0 THEN 'a, b' ELSE '' END AS keywords,
CASE WHEN n_nationkey % 2 = 0 THEN '1234-567X' ELSE '' END AS issn, '{BASE}/submission/wizard' AS "submitUrl", CASE WHEN n_nationkey % 2 = 0 THEN {_IMG(f"'{BASE}/logo.png'", "'logo.png'")} ELSE '' END AS logo,
CASE WHEN n_nationkey % 2 = 0 THEN {_IMG("'https://x.example/f' || n_nationkey || '.ico'", "'f' || n_nationkey || '.ico'")} ELSE '' END AS favicon, CASE WHEN n_nationkey % 2 = 0 THEN '<div><p>Home of ' || n_name || '</p></div>' ELSE '' END AS "homepageHtml",
CASE WHEN n_nationkey % 2 = 0 THEN 'ISSN: 1234-567X <a href="__BASE__articles/' || n_nationkey || '/">a</a>' ELSE '' END AS "footerHtml", CASE WHEN n_nationkey % 2 = 0 THEN 'Our team|team;Issues|issue/archive' ELSE '' END AS nav,
CASE WHEN n_nationkey % 2 = 0 THEN 'b|Side|true|<a href="__BASE__team/">t</a>' ELSE '' END AS blocks FROM nation""",
    "page_record": f"""SELECT s_suppkey::VARCHAR AS key, CASE WHEN s_suppkey % 5 > 0 THEN 'About ' || s_name END AS title, CASE WHEN s_suppkey % 5 > 0 THEN '<div><a href="__BASE__issues/' || s_suppkey || '/">i</a> <a href="mailto:a@b">m</a></div><h1>2</h1>' END AS html,
CASE WHEN s_suppkey % 5 > 0 THEN '{BASE}/' || s_suppkey END AS "sourceUrl", CASE WHEN s_suppkey % 5 = 0 THEN 'Missing: no page' END AS error FROM supplier""",
    "issue_records": f"""SELECT (s_suppkey % 10)::VARCHAR AS key, (row_number() OVER (PARTITION BY s_suppkey % 10 ORDER BY s_suppkey) - 1)::INTEGER AS pos, s_suppkey::VARCHAR AS id, 'Vol ' || s_suppkey AS title, 'S ' || s_name AS series, '<a href="__BASE__about/">d</a>' AS "descriptionHtml",
{_IMG(f"'{BASE}/issue/c' || s_nationkey || '.jpg'", "'c' || s_nationkey || '.jpg'")} AS cover, '{BASE}/issue/view/' || s_suppkey AS "ojsUrl" FROM supplier WHERE s_suppkey % 4 IN (0, 3)""",
    "issue_tocs": """SELECT n_nationkey::VARCHAR AS key, CASE WHEN n_nationkey % 7 > 0 THEN '2024-01-' || lpad(n_nationkey::VARCHAR, 2, '0') END AS "datePublished", CASE WHEN n_nationkey % 7 > 0 THEN '<p>' || n_name || '</p>' END AS "descriptionHtml", CASE WHEN n_nationkey % 7 > 0 THEN 1 END::INTEGER AS n_sections,
CASE WHEN n_nationkey % 7 > 0 THEN 'a' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN ',b' || n_nationkey ELSE '' END END AS articles, CASE WHEN n_nationkey % 7 > 0 THEN 'Articles' END AS section, CASE WHEN n_nationkey % 7 = 0 THEN 'Missing: no table of contents' END AS error FROM nation""",
    "article_records": f"""SELECT p_partkey::VARCHAR AS key, 'On ' || p_name AS title, 'Sub' AS subtitle, '2024-02-03' AS "datePublished", 'Ann (2024).' AS citation, 'Ann ' || p_partkey || '|X, Y|https://orcid.org/' || p_partkey || CASE WHEN p_partkey % 2 = 1 THEN ';Second||' ELSE '' END AS authors,
CASE WHEN p_partkey % 3 = 0 THEN '10.1/' || p_partkey ELSE '' END AS doi, p_brand || ',two' AS keywords, '<p>Text of ' || p_name || '</p>' AS "abstractHtml", '<p><a href="__BASE__articles/z/">r</a></p>' AS "referencesHtml", '<p>CC</p>' AS "licenseHtml", '9' || p_partkey AS "submissionId",
'{BASE}/citationstylelanguage/download/bibtex?submissionId=8' || p_partkey AS "bibtexUrl", '{BASE}/citationstylelanguage/download/ris?submissionId=9' || p_partkey AS "risUrl", p_type AS section, 'C1,C2' AS categories,
CASE WHEN p_partkey % 2 = 1 THEN 'PDF|true|' ELSE 'Text|false|' END || '{BASE}/article/view/' || p_partkey || '/3|{BASE}/article/download/' || p_partkey || '/3|' || CASE WHEN p_partkey % 2 = 1 THEN p_partkey || '-3.pdf' ELSE '' END AS galleys, '{BASE}/article/view/' || p_partkey AS "ojsUrl" FROM part""",
    "team_sections": """SELECT n_nationkey::VARCHAR AS key, 0 AS pos, 'Editors of ' || n_name AS title, 'Ann ' || n_name || ' (X): chief;Bob' AS members, true AS "hasPhotos", '<p>A <i>note</i></p>' AS "noteHtml" FROM nation
UNION ALL SELECT n_nationkey::VARCHAR, 1, 'Support', '', false, '<p>We thank ' || n_name || '</p>' FROM nation""",
    "announcement_records": f"""SELECT c_custkey::VARCHAR AS key, CASE WHEN c_nationkey % 2 = 0 THEN 'News' ELSE 'About ' || c_name END AS title, '2024-05-06' AS date, CASE WHEN c_nationkey % 3 > 0 THEN '<p>Body</p>' ELSE '' END AS html, '{BASE}/announcement/view/' || c_custkey AS "ojsUrl", NULL::VARCHAR AS error FROM customer WHERE c_custkey % 3 = 0""",
    "guide_sections": "SELECT p_partkey, 0 AS ord, 'For ' || p_name AS heading, '<p>x</p>tail' AS html FROM part UNION ALL SELECT p_partkey, 1, 'About', '<ul><li>' || p_brand || '</li></ul>' FROM part",
    "discovered_pages": """WITH p AS (SELECT page_id AS ord, string_split(url, '/')[4] AS path FROM pages), f AS (SELECT path, min(ord) AS ord FROM p WHERE path <> 'en' AND NOT starts_with(path, 'f') AND path <> '' GROUP BY path)
SELECT path, 0 AS rank, ord FROM f UNION ALL SELECT e, 1, i FROM (VALUES ('de', 0::BIGINT), ('legal-disclosure', 1::BIGINT)) AS t(e, i) WHERE e NOT IN (SELECT path FROM f)""",
    "cleaned_fragments": f"""SELECT p_partkey::VARCHAR AS key, '<div><div>' || p_name || '</div><a href="__BASE__articles/' || p_partkey || '/">a</a><a href="__BASE__issues/">i</a><a href="https://y.example/">y</a><img src="' || {_IMG("'https://x.example/i/' || p_partkey || ' x.png'", "p_partkey || '_x.png'")} || '"></div>' AS clean FROM part""",
    "view_panels": """SELECT n_nationkey::VARCHAR AS key, CASE WHEN n_nationkey % 2 = 0 THEN '<div><button id="tab-html" class="t is-active" aria-selected="true">H</button><div id="panel-html" class="is-active">' ELSE '<div><button id="tab-html" class="t" aria-selected="false">H</button><div id="panel-html" hidden="">' END
|| '<img src="data:image/png;base64,AA=="><img src="//h/b.png"><img src="/c.png">' || n_name || '</div></div>' AS view FROM nation""",
}
