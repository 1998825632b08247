"""URL, page and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import dates, ids, text
from quillspark.plans.tables import table

BASES = ["https://m.therou.example.com/en", "https://blog.tiontion.example.com/en"]
KNOWN = ["853", "474.html"]


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def _host(url):
    return F.parse_url(url, F.lit("HOST"))


def url_path(spark, sf_dir):
    """Path inside the page's own site and language, as for a journal at that base."""
    p = _pages(spark, sf_dir).select("page_id", "url", F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("base"))
    rest = F.substr("url", F.length("base") + 1)
    return p.select("page_id", F.regexp_replace(F.substring_index(F.substring_index(rest, "#", 1), "?", 1), "^/+|/+$", "").alias("path"), ids.journal_path(F.col("url"), BASES).alias("journal_path"))


def url_routes(spark, sf_dir):
    """Every rule of the router, and addresses that none takes: the page number says which."""
    forms = ["article/view/{}", "article/view/{}/9/x", "issue/view/{}", "issue/view/{}/x", "issue/archive", "issues", "issue/current", "announcement/view/{}", "announcement", "index", "home", "", "about/team", "{}", "article/view"]
    p = _pages(spark, sf_dir).select("page_id", F.replace(F.element_at(F.array(*map(F.lit, forms)), (F.col("page_id") % len(forms) + 1).cast("int")), F.lit("{}"), F.col("page_id").cast("string")).alias("path"))
    base = F.element_at(F.array(*map(F.lit, ["https://j.example", "https://old.example/j", "https://j.example.org"])), (F.floor(F.col("page_id") / len(forms)) % 3 + 1).cast("int"))
    return p.select("page_id", ids.rewrite_url(F.concat(base, F.lit("/"), "path", F.lit("/?x=1#y")), ["https://j.example", "https://old.example/j"], ["about/team"]).alias("route"))


def url_route(spark, sf_dir):
    """Page URLs rewritten as routes of a journal: the language segment stands for the kind of page."""
    p = _pages(spark, sf_dir).select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+/(en|fr)/", "https://j.example/article/view/"), "^https?://[^/]+/(de|es)/", "https://j.example/issue/view/").alias("u"))
    return p.select("page_id", ids.rewrite_url(F.col("u"), ["https://j.example"], KNOWN).alias("route"))


def page_links(spark, sf_dir):
    """Every link of a page, resolved against its URL, and whether it leaves the host. By its place a link is left as it is,
    led to another host, made a fragment, a mail address or blank, or spelt with its own host."""
    links = _pages(spark, sf_dir).select("page_id", "url", F.posexplode(text.hrefs(F.col("html"))).alias("pos", "h"))
    own = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    href = F.element_at(F.array("h", F.concat(F.lit("https://other.example"), "h"), F.concat(F.lit("#"), "h"), F.concat(F.lit("MAILTO:a@b?"), "h"), F.lit(" "), F.concat(own, "h")), (F.col("pos") % 6 + 1).cast("int"))
    links = links.withColumn("href", href)
    full = F.when(F.col("href").startswith("/"), F.concat(own, "href")).otherwise(F.col("href"))
    return links.select("page_id", "pos", "href", full.alias("target"), ids.is_external(full, _host(F.col("url"))).alias("external"))


def page_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", text.flatten_html(F.col("html")).alias("text"))


def page_excerpt(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", text.excerpt(F.col("html"), 240).alias("excerpt"))


def doc_excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.col("text"), 180).alias("excerpt"))


def page_regions(spark, sf_dir):
    """Title and article of a page, escaped and as script-safe JSON."""
    p = _pages(spark, sf_dir).select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))
    return p.select("page_id", text.html_escape(F.col("title")).alias("escaped"), text.script_json(F.struct("title")).alias("json"))


def slug_initials_hue(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", text.slug_heading(F.col("p_name")).alias("slug"))
    return p.select("p_partkey", "slug", text.initials(F.col("p_name")).alias("initials"), text.hue(F.col("slug")).alias("hue"))


def slug_lines(spark, sf_dir):
    """Slugs of every line of documents with accents."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.select("doc_id", "pos", text.slug_team(F.col("line")).alias("slug"))


def sha_name(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", ids.image_name(F.col("url")).alias("name"))


def doi_forms(spark, sf_dir):
    """DOI and URL normalisers on strings made from part keys."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.element_at(F.array(*map(F.lit, ["https://doi.org/10.1234/AB", " HTTPS://DX.DOI.ORG/10.55555/x", "10.1234/", "www.zenodo.org/", "-", "10.12/"])), (F.col("p_partkey") % 6 + 1).cast("int")), F.when(F.col("p_partkey") % 6 == 4, "").otherwise(F.col("p_partkey").cast("string"))).alias("v"))
    v = F.col("v")
    return p.select("p_partkey", ids.bare_doi(v).alias("bare"), ids.preprint_doi(v, legacy=True).alias("preprint"), ids.doi_or_url(v).alias("url"), ids.prereview_url(ids.bare_doi(v)).alias("prereview"))


def path_forms(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("/r2/"), "n_name", F.lit("/")).alias("p"), "n_name")
    p = F.col("p")
    return n.select("n_nationkey", ids.base_path(p).alias("base"), ids.page_path(F.array(F.lit("articles"), F.lit(""), p)).alias("page"), ids.serve_path(p, "/r2").alias("served"), ids.viewer_url("viewer.html?file=", p).alias("viewer"), ids.rebase(F.lit("__BASE__issues/"), p).alias("rebased"))


def sheet_dates(spark, sf_dir):
    """German dates of orders, every fifth one spelt out, back to ISO."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "  n/a ").otherwise(F.date_format("o_orderdate", "d.M.yyyy")).alias("d"))
    return o.select("o_orderkey", dates.parse_de(F.col("d")).alias("iso"), dates.month_of(dates.parse_de(F.col("d"))).alias("ym"), dates.year_of(dates.parse_de(F.col("d"))).alias("year"))


def person_split(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(" ("), "c_mktsegment", F.when(F.col("c_nationkey") > 12, "): editor").when(F.col("c_nationkey") > 6, ")").otherwise("")).alias("v"))
    return c.select("c_custkey", text.person_split(F.col("v")).alias("s")).select("c_custkey", "s.name", "s.affiliation", "s.roles")


def bionic(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.bionic(F.col("text")).alias("bionic"))


def citation_links(spark, sf_dir):
    """Citations that spell out a URL, with the URL as a link."""
    p = _pages(spark, sf_dir)
    return p.select("page_id", text.linkify(F.concat(F.lit("A & B (2020). "), "url", F.lit(" "), "url"), F.col("url")).alias("linked"))


def jats(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("<jats:p><jats:italic>"), "text", F.lit("</jats:italic> &amp;amp; <jats:sec id='x'>y</jats:sec></jats:p>"))).otherwise(F.col("text")).alias("v"))
    return b.select("item_id", text.jats_to_html(F.col("v")).alias("html"))


def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


_ESC = lambda x: f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_UN = lambda x: f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"
_FLAT = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_BASE = "regexp_extract(url, '^(https?://[^/]+)', 1)"
_TRIMMED = "trim(split_part(split_part({}, '#', 1), '?', 1), '/')"
_CUT = "CASE WHEN length(t) > {n} THEN regexp_replace(substr(t, 1, {n}), ' [^ ]*$', '') || '…' ELSE t END AS excerpt"

QUERIES = {f.__name__: f for f in (url_path, url_route, url_routes, page_links, page_text, page_excerpt, doc_excerpt, page_regions, slug_initials_hue, slug_lines, sha_name, doi_forms, path_forms, sheet_dates, person_split, bionic, citation_links, jats, json_props)}
SQL = {
    "url_path": f"SELECT page_id, {_TRIMMED.format(f'substr(url, length({_BASE}) + 1)')} AS path, CASE " + " ".join(f"WHEN url = '{b}' OR starts_with(url, '{b}/') THEN {_TRIMMED.format(f'substr(url, {len(b) + 1})')}" for b in BASES) + " END AS journal_path FROM pages",
    "url_route": """WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]+/(en|fr)/', 'https://j.example/article/view/'), '^https?://[^/]+/(de|es)/', 'https://j.example/issue/view/') AS u FROM pages),
p AS (SELECT page_id, u, CASE WHEN starts_with(u, 'https://j.example/') THEN trim(split_part(split_part(substr(u, 18), '#', 1), '?', 1), '/') END AS p FROM u)
SELECT page_id, CASE WHEN p IS NULL THEN u WHEN regexp_matches(p, '^article/view/[^/]+(/.*)?$') THEN '__BASE__articles/' || split_part(p, '/', 3) || '/' WHEN regexp_matches(p, '^issue/view/[^/]+$') THEN '__BASE__issues/' || split_part(p, '/', 3) || '/' ELSE u END AS route FROM p""",
    "page_links": f"""WITH l AS (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages), x AS (SELECT page_id, {_BASE} AS own, unnest(h) AS h, unnest(range(0, len(h))) AS pos FROM l),
y AS (SELECT *, [h, 'https://other.example' || h, '#' || h, 'MAILTO:a@b?' || h, ' ', own || h][pos % 6 + 1] AS href FROM x)
SELECT page_id, pos::INTEGER AS pos, href, CASE WHEN starts_with(href, '/') THEN own || href ELSE href END AS target, pos % 6 = 1 AS external FROM y""",
    "url_routes": """WITH p AS (SELECT page_id, page_id % 15 AS k, page_id // 15 % 3 AS b FROM pages)
SELECT page_id, CASE WHEN b = 2 OR k IN (3, 13, 14) THEN ['https://j.example', 'https://old.example/j', 'https://j.example.org'][b + 1] || '/' || replace(['article/view/{}', 'article/view/{}/9/x', 'issue/view/{}', 'issue/view/{}/x', 'issue/archive', 'issues', 'issue/current', 'announcement/view/{}', 'announcement', 'index', 'home', '', 'about/team', '{}', 'article/view'][k + 1], '{}', page_id::VARCHAR) || '/?x=1#y'
ELSE '__BASE__' || CASE WHEN k <= 1 THEN 'articles/' || page_id || '/' WHEN k = 2 THEN 'issues/' || page_id || '/' WHEN k <= 6 THEN 'issues/' WHEN k = 7 THEN 'announcements/' || page_id || '/' WHEN k = 8 THEN 'announcements/' WHEN k <= 11 THEN '' ELSE 'about/team/' END END AS route FROM p""",
    "page_text": "SELECT page_id, regexp_replace(" + _FLAT(_UN("regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<!--.*?-->|<!doctype[^>]*>', ' ', 'g'), '<[^>]+>', ' ', 'g')")) + ", '\\s+([,.;:])', '\\1', 'g') AS text FROM pages",
    "page_excerpt": "WITH t AS (SELECT page_id, " + _FLAT(_UN("regexp_replace(html, '<[^>]+>', ' ', 'g')")) + f" AS t FROM pages) SELECT page_id, {_CUT.format(n=240)} FROM t",
    "doc_excerpt": "WITH t AS (SELECT doc_id, " + _FLAT("regexp_replace(text, '<[^>]+>', ' ', 'g')") + f" AS t FROM documents) SELECT doc_id, {_CUT.format(n=180)} FROM t",
    "page_regions": f"WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages) SELECT page_id, {_ESC('title')} AS escaped, replace(json_object('title', title)::VARCHAR, '</', '<\\/') AS json FROM p",
    "slug_initials_hue": """WITH s AS (SELECT p_partkey, string_split(p_name, ' ') AS w, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part)
SELECT p_partkey, slug, upper(CASE WHEN len(w) > 1 THEN w[1][1] || w[-1][1] ELSE substr(w[1], 1, 2) END) AS initials, (list_sum([ascii(c) for c in string_split(slug, '')]) % 5)::INTEGER AS hue FROM s""",
    "slug_lines": """WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10)))))::INTEGER AS pos, unnest(string_split(text, chr(10))) AS x FROM documents),
g AS (SELECT doc_id, pos, replace(replace(replace(replace(replace(replace(replace(x, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue') AS x FROM l)
SELECT doc_id, pos, trim(regexp_replace(lower(strip_accents(x)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM g""",
    "sha_name": "SELECT page_id, substr(sha1(url), 1, 8) || '-' || regexp_replace(string_split(split_part(split_part(url, '#', 1), '?', 1), '/')[-1], '[^A-Za-z0-9._-]', '_', 'g') AS name FROM pages",
    "doi_forms": """WITH p AS (SELECT p_partkey, ['https://doi.org/10.1234/AB', ' HTTPS://DX.DOI.ORG/10.55555/x', '10.1234/', 'www.zenodo.org/', '-', '10.12/'][p_partkey % 6 + 1] || CASE WHEN p_partkey % 6 = 4 THEN '' ELSE p_partkey::VARCHAR END AS v FROM part),
b AS (SELECT p_partkey, trim(v) AS v, lower(regexp_replace(trim(v), '(?i)^https?://(dx\\.)?doi\\.org/', '')) AS bare FROM p)
SELECT p_partkey, bare, regexp_replace(v, '^https?://(dx\\.)?doi\\.org/', '') AS preprint, CASE WHEN regexp_matches(v, '(?i)^https?://') THEN v WHEN regexp_matches(v, '^10\\.\\d{4,}/\\S+$') THEN 'https://doi.org/' || v
WHEN regexp_matches(v, '(?i)^[a-z0-9-]+(\\.[a-z0-9-]+)+(/\\S*)?$') THEN 'https://' || v ELSE '' END AS url, 'https://prereview.org/preprints/doi-' || replace(bare, '/', '-') || '/write-a-prereview' AS prereview FROM b""",
    "path_forms": """WITH n AS (SELECT n_nationkey, '/r2/' || n_name || '/' AS p, n_name FROM nation)
SELECT n_nationkey, '/r2/' || n_name || '/' AS base, 'articles/r2/' || n_name AS page, '/' || n_name || '/' AS served, 'viewer.html?file=' || url_encode(p) AS viewer, p || 'issues/' AS rebased FROM n""",
    "sheet_dates": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m') END AS ym, CASE WHEN o_orderkey % 5 <> 0 THEN year(o_orderdate) END::INTEGER AS year FROM orders""",
    "person_split": "SELECT c_custkey, c_name AS name, c_mktsegment AS affiliation, CASE WHEN c_nationkey > 12 THEN 'editor' ELSE '' END AS roles FROM customer",
    "bionic": """SELECT item_id, array_to_string([('<b>' || substr(w, 1, greatest(1, ceil(length(w) * 0.5)::INTEGER)) || '</b>' || substr(w, greatest(1, ceil(length(w) * 0.5)::INTEGER) + 1)) for w in string_split_regex(text, '\\s+') if w <> ''], ' ') AS bionic FROM benchmark""",
    "citation_links": f"WITH e AS (SELECT page_id, {_ESC('url')} AS u FROM pages) SELECT page_id, 'A &amp; B (2020). <a href=\"' || u || '\">' || u || '</a> ' || u AS linked FROM e",
    "jats": "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN '<p><em>' || text || '</em> & y</p>' ELSE '<p>' || trim(text) || '</p>' END AS html FROM benchmark",
    "json_props": "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events",
}
