"""References, sheet rows, registries, page regions, and files that are written and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import functions as F

from quillspark.functions import dates, ids, text
from quillspark.operators import citations, registries, site
from quillspark.plans.tables import table
from quillspark.sources import readers, sinks


def _scratch(spark, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir (on a local master a temporary one), gone when the application ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    path = f"{folder}/quillspark-files/{name}-{uuid.uuid4().hex}"

    def drop():
        try:
            at, fs = sinks._fs(spark, path)
            fs.delete(at, True)
        except Exception:  # the session has ended; its owner clears the folder
            pass

    atexit.register(drop)
    return path


def _references(spark, sf_dir):
    """Reference lists of suppliers: one author, two, three, a lone name, and paragraphs that are no reference."""
    s = table(spark, sf_dir, "supplier")
    html = (
        "<p>Mc%s, A. (2001). One <i>title</i> .</p><p>Ärnst, B., &amp; O'Neil, C. (1999a). Two.</p><p class='x'>Du Bois, W., Zed, Y., & Xu, X. (2010b) Three</p><p>Unicef (2020). Lone.</p><p>No year, A. B.</p><p>(2020) no name</p><p>Mc%s, D. (2001). Same form.</p>"
    )
    return s.select(F.col("s_suppkey").alias("doc"), F.format_string(html, *[F.col("s_suppkey").cast("string")] * 2).alias("refs"))


def reference_rows(spark, sf_dir):
    r = citations.reference_rows(_references(spark, sf_dir), "doc", "refs")
    return r.select("doc", F.col("ord").cast("int").alias("ord"), "html", F.array_join("surnames", "|").alias("surnames"), "year")


def citation_surfaces(spark, sf_dir):
    """Forms of each reference; of references that share one the first counts."""
    return citations.surfaces(citations.reference_rows(_references(spark, sf_dir), "doc", "refs"), "doc")


def linked_citations(spark, sf_dir):
    """Citations in a text with markup become references with a tooltip, the longest form first, tags left alone."""
    refs = _references(spark, sf_dir)
    forms = citations.surfaces(citations.reference_rows(refs, "doc", "refs"), "doc").where("doc % 4 > 0")
    docs = refs.select("doc", F.format_string('<p title="Unicef (2020)">See Unicef (2020) and Unicef 2020b; Du Bois et al., 2010b, Ärnst &amp; O\'Neil 1999a.</p>%s', F.col("doc").cast("string")).alias("text"))
    return citations.link_citations(docs, forms, "doc", "text")


def longest_forms(spark, sf_dir):
    """Forms of a document from the longest to the shortest, as they are tried."""
    f = citations.surfaces(citations.reference_rows(_references(spark, sf_dir), "doc", "refs"), "doc")
    return f.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.length("surface")).alias("n"), "surface"))), lambda x: x["surface"]), "|").alias("forms"))


def bibtex(spark, sf_dir):
    """Entries with commas inside braces, with a comma at the end, and text that is no entry."""
    p = table(spark, sf_dir, "part")
    entry = F.format_string("@article{k%s, author={Last, First and %s}, title={{A, b}}, year={2020}%s}", F.col("p_partkey").cast("string"), "p_name", F.when(F.col("p_partkey") % 2 == 0, ",").otherwise(""))
    return p.select("p_partkey", text.bibtex_format(F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(entry)).alias("bib"))


def _registries(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("doi", F.concat(F.lit("10.1234/"), "p_partkey"))
    no = F.lit(None).cast("string")
    one = p.where("p_partkey % 3 = 0").select(
        "doi", F.array(F.concat("p_name", F.lit(" &amp;amp; co"))).alias("title"),
        F.array(*[F.struct(a.alias("given"), b.alias("family"), c.alias("ORCID")) for a, b, c in ((F.lit("Ann"), F.col("p_brand"), no), (no, no, F.lit("x")), (F.lit(""), F.lit("Lee"), F.lit("o")))]).alias("author"),
        F.concat(F.lit("<jats:p>"), "p_type", F.lit("</jats:p>")).alias("abstract"),
    )
    identifiers = F.array(*[F.struct(F.lit(s).alias("nameIdentifierScheme"), F.lit(v).alias("nameIdentifier")) for s, v in (("ISNI", "i"), ("orcid", "o1"), ("ORCID", "o2"))])
    two = p.where("p_partkey % 3 < 2").select(
        "doi", F.array(F.struct(F.concat(F.lit(" Second "), "p_name").alias("title"))).alias("titles"),
        F.array(*[F.struct(a.alias("givenName"), b.alias("familyName"), c.alias("name"), identifiers.alias("nameIdentifiers")) for a, b, c in ((F.lit("Bo"), F.lit(""), no), (no, no, F.lit("Group")), (no, no, no))]).alias("creators"),
        F.array(*[F.struct(F.lit(a).alias("descriptionType"), F.lit(b).alias("description")) for a, b in (("Methods", "m"), (" ABSTRACT ", "text"), ("Abstract", "later"))]).alias("descriptions"),
    )
    return p, registries.first_registry(one), registries.second_registry(two)


def registry_records(spark, sf_dir):
    """What two registries know of each DOI; the second is asked for what the first lacks."""
    p, one, two = _registries(spark, sf_dir)
    r = registries.lookup(p.select("doi"), one, two)
    return r.select("doi", "title", F.array_join(F.transform("authors", lambda a: F.concat_ws("|", a["name"], a["orcid"])), ";").alias("authors"), "abstract")


def _sheet(spark, sf_dir):
    """A sheet from parts: statuses that end a review and such that do not, ids that are no numbers, dates in two spellings."""
    p = table(spark, sf_dir, "part")
    k, c = F.col("p_partkey"), F.col("p_partkey").cast("string")
    pick = lambda m, *v: F.element_at(F.array(*[F.lit(x) if not hasattr(x, "alias") else x for x in v]), (k % m + 1).cast("int"))
    return p.select(
        pick(5, c, F.concat(F.lit(" "), c), F.concat(F.lit("x"), c), c, c).alias("ID"), pick(7, "In review", "Accepted with changes", "Unpublished", "desk reject", "", "Revision", None).alias("Stage website"),
        pick(4, F.concat(F.lit("— 12 "), F.col("p_name")), "12", F.lit(None).cast("string"), F.concat("p_name", F.lit("—"))).alias("GDrive Folder"), pick(3, F.col("p_brand"), "", F.lit(None).cast("string")).alias("First Author"),
        pick(2, F.concat(F.lit("https://doi.org/10.1234/"), c), "none yet").alias("Preprint"), F.lit(" https://pubpeer.com/x ").alias("PubPeer Comments"), F.lit(None).cast("string").alias("Lay Summary"), F.col("p_type").alias("Handling Editor"),
        pick(3, F.concat(F.lit("5."), (k % 12 + 1).cast("string"), F.lit(".2024")), "soon", "").alias("Submission Date"),
        pick(6, F.concat(F.lit(" https://doi.org/10.9/A"), (k % 30).cast("string")), "", F.concat(F.lit("10.9/b"), c), "", "", F.lit(None).cast("string")).alias("Published DOI"), pick(4, "-", F.concat(F.lit("www.a.org/"), c), F.lit(None).cast("string"), "10.5555/r").alias("Peer Review Report"),
        F.lit("").alias("Reproducibility Certificate"), pick(12, *["http://d.org"] * 6, *[""] * 6).alias("Data"), F.lit("not a link").alias("Materials"), k.alias("ord"),
    )


def under_review(spark, sf_dir):
    """Rows under review with what the registries know of their preprints."""
    p, one, two = _registries(spark, sf_dir)
    r = site.under_review(_sheet(spark, sf_dir), registries.lookup(p.select("doi"), one, two))
    return r.select("id", "title", F.array_join(F.transform("authors", lambda a: a["name"]), ";").alias("authors"), "preprintUrl", "prereviewUrl", "pubpeerUrl", "abstractHtml", "laySummary", "status", "handlingEditor", "submissionDate")


def published_extras(spark, sf_dir):
    """Links by published DOI; rows without a link are dropped, the last row of a DOI counts."""
    return site.published_extras(_sheet(spark, sf_dir), "ord")


def visible_blocks(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    blocks = F.array(*[F.struct(F.lit(i).alias("id"), h.alias("titleHidden")) for i, h in (("a", F.lit(True)), ("b", F.col("n_nationkey") % 2 == 0), ("c", F.lit(None).cast("boolean")))])
    return n.select("n_nationkey", blocks.alias("sidebarBlocks")).select("n_nationkey", F.array_join(F.transform(site.visible_blocks(), lambda b: b["id"]), ",").alias("shown"))


def names_and_fallbacks(spark, sf_dir):
    """Names from parts or a literal, titles from folders, first values that are not blank or that match."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    given, family, literal = F.when(k < 2, "Ann").when(k == 2, ""), F.when(k % 2 == 0, F.col("p_brand")), F.when(k != 1, F.col("p_name"))
    values = F.array(F.when(k == 0, F.col("p_name")).otherwise(" "), F.lit("\t"), F.when(k < 3, F.col("p_type")))
    return p.select(
        "p_partkey", text.person_name(given, family).alias("joined"), text.person_name(given, family, literal).alias("name"), text.folder_title(F.concat(F.lit(" --"), F.when(k == 3, F.lit("")).otherwise(F.col("p_name")), F.lit("17 "))).alias("left"),
        text.folder_title(F.concat(F.lit("17 "), F.when(k == 3, F.lit("")).otherwise(F.col("p_name")))).alias("title"), text.first_nonblank(values).alias("nonblank"), text.first_where(values, lambda x: x.contains("a")).alias("match"), text.fallback(given, literal, last="none").alias("fallback"),
    )


def namespaced_pages(spark, sf_dir):
    """Ids and references to them with the page's anchor, foreign references left alone; links of a site as fragments."""
    n = table(spark, sf_dir, "nation")
    page = F.format_string('<p id="top">%s</p><a href="#top">t</a><a href="#other">o</a><label for="top">l</label><i aria-controls="top"></i><script>document.getElementById(\'top\')</script>', "n_name")
    links = F.format_string('<a href="/">h</a><a href="/a/b/">b</a><a href="/a/#part">p</a><a href="/a/%s#preview">v</a><a href="https://x/">x</a>', "n_name")
    return n.select("n_nationkey", text.namespace_ids(page, F.concat(F.lit("p"), F.col("n_nationkey").cast("string"))).alias("page"), text.namespace_ids(F.col("n_name"), F.lit("x")).alias("plain"), text.internal_hrefs(links).alias("links"))


def regions(spark, sf_dir):
    """Main, header and footer of pages; pages without them; the logo of a footer and the rest."""
    n = table(spark, sf_dir, "nation")
    full = F.format_string('<header class="site-header"><b>%s</b></header><main id="main"><p>%s</p></main><footer class="site-footer"><p> <img src="l.png"> </p><p>rest</p><p><img src="m.png"></p></footer>', "n_name", "n_name")
    page = F.when(F.col("n_nationkey") % 3 > 0, full).otherwise(F.col("n_name"))
    r = n.select("n_nationkey", page.alias("p")).select("n_nationkey", text.main_region(F.col("p")).alias("main"), text.region(F.col("p"), "header", "site-header").alias("header"), text.region(F.col("p"), "footer", "site-footer").alias("footer"))
    return r.select("*", text.footer_split(F.col("footer"))["logo"].alias("logo"), text.footer_split(F.col("footer"))["rest"].alias("rest"))


def today(spark, sf_dir):
    """Yesterday and the day of the current time in UTC."""
    return table(spark, sf_dir, "region").select("r_regionkey", dates.yesterday().alias("yesterday"), F.substring(dates.now_utc(), 1, 10).alias("day"), F.substring(dates.now_utc(), 17, 4).alias("zone"))


def json_round_trip(spark, sf_dir):
    """Announcements written as JSON, read with their schema; then rows that keep what is there, and a file that is absent."""
    path = _scratch(spark, "announcements")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.lit("ä\"\n").alias("html"))
    sinks.json_atomic(c, path)
    assert not sinks.keep_previous(c.limit(0), path)
    back = spark.read.schema(readers.SCHEMAS["announcements"]).json(path)
    return back.select("id", "title", "date", "html").unionByName(readers.optional_json(spark, path + "-absent", "announcements").select("id", "title", "date", "html"))


def keyed_json(spark, sf_dir):
    """Statistics by key: one JSON object a region, of its nations."""
    path = _scratch(spark, "stats")
    entry = F.struct(F.col("n_nationkey").alias("ojsViews"), F.create_map(F.lit("2024-01"), F.col("n_regionkey")).alias("monthlyOjsViews"))
    n = table(spark, sf_dir, "nation").groupBy(F.concat("n_regionkey", F.lit(".json")).alias("path")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", entry)))).alias("content"))
    sinks.write_pages(n, path).write.format("noop").mode("overwrite").save()
    back = readers.keyed_json(spark, path, "stats_entry", "id")
    return back.select("id", "ojsViews", F.col("monthlyOjsViews")["2024-01"].alias("january"), "pdfDownloads")


def item_lists(spark, sf_dir):
    """JSON lists, objects with items, and what is neither."""
    n = table(spark, sf_dir, "nation")
    one = F.to_json(F.array(F.struct(F.col("n_name").alias("date"), F.lit("3").alias("value"))))
    v = F.when(F.col("n_nationkey") % 3 == 0, one).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit('{"items": '), one, F.lit("}"))).otherwise("<html>")
    return n.select("n_nationkey", F.explode_outer(readers.items(v, "date STRING, value STRING")).alias("i")).select("n_nationkey", "i.date", "i.value")


def sheet_round_trip(spark, sf_dir):
    """A sheet with quotes, commas and line breaks inside its cells: every column is text."""
    path = _scratch(spark, "sheet")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(', "q"\nsecond')).alias("note"), "c_acctbal")
    c.write.csv(path, header=True, escape='"')
    return readers.sheet(spark, path).select("c_custkey", "note", F.round(F.col("c_acctbal").cast("double") * 100).cast("long").alias("cents"))


def file_probe(spark, sf_dir):
    """Photos and PDFs written as pages: for each name the file of the first extension, payloads that are PDFs, and files that
    a mirror lacks."""
    folder = _scratch(spark, "files")
    n = table(spark, sf_dir, "nation")
    named = lambda ext, body, keep: n.where(keep).select(F.concat("n_name", F.lit(ext)).alias("path"), F.concat(F.lit(body), "n_name").alias("content"))
    made = named(".png", "p", "n_nationkey % 2 = 0").unionByName(named(".jpg", "j", "n_nationkey % 3 = 0")).unionByName(named(".pdf", "%PDF", "n_nationkey % 4 > 0")).unionByName(named("-x.pdf", "<html>", "n_nationkey % 4 = 0"))
    sinks.write_pages(made, folder).write.format("noop").mode("overwrite").save()
    files = readers.binaries(spark, folder)
    name = F.element_at(F.split("path", "/"), -1)
    photos = readers.probe(files, [".jpg", ".jpeg", ".png", ".webp"]).select(F.lit("photo").alias("kind"), "slug", name.alias("file"))
    pdfs = readers.pdfs(files).select(F.lit("pdf").alias("kind"), F.lit(None).cast("string").alias("slug"), name.alias("file"))
    known = named(".pdf", "%PDF", "n_nationkey % 4 = 1").select(F.col("path").alias("name"), F.octet_length("content").cast("long").alias("length"))
    new = readers.changed(readers.pdfs(files), known).select(F.lit("new").alias("kind"), F.lit(None).cast("string").alias("slug"), F.col("name").alias("file"))
    return photos.unionByName(pdfs).unionByName(new)


def single_page(spark, sf_dir):
    """All pages in the order of their groups as one text."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.concat(F.lit("<p>"), "n_name", F.lit("</p>")).alias("html"))
    return sinks.single_file(n, ["n_regionkey", "n_nationkey"], "html")


def written_pages(spark, sf_dir):
    """Pages written below a folder, read back by their paths."""
    folder = _scratch(spark, "site")
    n = table(spark, sf_dir, "nation")
    sinks.reset_site(spark, folder)
    sinks.write_pages(sinks.rendered(n, F.concat(F.lit("articles/"), "n_nationkey", F.lit("/index.html")), F.concat(F.lit("<main>é "), "n_name", F.lit("</main>"))), folder).write.format("noop").mode("overwrite").save()
    back = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.substring_index(F.input_file_name(), "/", -3).alias("path"), F.col("value").alias("content"))
    return back


def inline_settings(spark, sf_dir):
    """Settings of a text file as rows: comments and broken lines are left out, and a setting that one has stays."""
    pairs = readers.env_pairs('# c\n\nA = "x=1"\nB=\'y\'\nbad\nA2=z', {"B": "kept"})
    return readers.inline_rows(spark, sorted(pairs.items()), "k string, v string").drop("ord")


def image_names(spark, sf_dir):
    """Local names and data URIs of images up to a size; larger ones keep their address."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("https://x/i/"), "p_name", F.lit(".png?s=1")).alias("url"), F.encode("p_name", "utf-8").alias("content"))
    small = F.octet_length("content") <= 9
    return p.select("p_partkey", F.when(small, ids.image_name(F.col("url"))).otherwise(F.col("url")).alias("src"), F.when(small, text.data_uri(F.lit("image/png"), F.col("content"))).alias("uri"))


QUERIES = {f.__name__: f for f in (reference_rows, citation_surfaces, linked_citations, longest_forms, bibtex, registry_records, under_review, published_extras, visible_blocks, names_and_fallbacks, namespaced_pages, regions, today, json_round_trip, keyed_json, item_lists, sheet_round_trip, file_probe, single_page, written_pages, inline_settings, image_names)}

_REFS = """r AS (SELECT s_suppkey AS doc, v.* FROM supplier, (VALUES (0, 'Mc', ', A. (2001). One <i>title</i>.', 'Mc', '2001'), (1, 'Ärnst, B., &amp; O''Neil, C. (1999a). Two.', '', 'Ärnst|O''Neil', '1999a'), (2, 'Du Bois, W., Zed, Y., & Xu, X. (2010b) Three', '', 'Du Bois|Zed|Xu', '2010b'),
(3, 'Unicef (2020). Lone.', '', 'Unicef', '2020'), (6, 'Mc', ', D. (2001). Same form.', 'Mc', '2001')) AS v(ord, a, b, names, year)), q AS (SELECT doc, ord, CASE WHEN b <> '' THEN a || doc || b ELSE a END AS html, CASE WHEN b <> '' THEN names || doc ELSE names END AS surnames, year FROM r)"""
_FORMS = f"""{_REFS}, w AS (SELECT *, CASE len(string_split(surnames, '|')) WHEN 1 THEN surnames WHEN 2 THEN replace(surnames, '|', ' &amp; ') ELSE split_part(surnames, '|', 1) || ' et al.' END AS who FROM q),
f AS (SELECT doc, ord, html, unnest([who || ' (' || year || ')', who || ', ' || year, who || ' ' || year]) AS surface FROM w), s AS (SELECT doc, surface, arg_min(html, ord) AS html FROM f GROUP BY doc, surface)"""
_REG = """p AS (SELECT *, '10.1234/' || p_partkey AS doi FROM part), l AS (SELECT doi, p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' & co' WHEN 1 THEN 'Second ' || p_name END AS title, CASE p_partkey % 3 WHEN 0 THEN 'Ann ' || p_brand || '|;Lee|o' WHEN 1 THEN 'Bo|o1;Group|o1' END AS authors,
CASE p_partkey % 3 WHEN 0 THEN '<p>' || p_type || '</p>' WHEN 1 THEN '<p>text</p>' END AS abstract FROM p)"""
_MARK = lambda form, note: f"""'<span class="cite-ref" tabindex="0">{form}<span class="cite-tooltip">{note}</span></span>'"""
SQL = {
    "reference_rows": f"WITH {_REFS} SELECT doc, ord::INTEGER AS ord, html, surnames, year FROM q",
    "citation_surfaces": f"WITH {_FORMS} SELECT * FROM s",
    "linked_citations": f"""SELECT s_suppkey AS doc, '<p title="Unicef (2020)">See ' || CASE WHEN s_suppkey % 4 > 0 THEN {_MARK("Unicef (2020)", "Unicef (2020). Lone.")} || ' and ' || {_MARK("Unicef 2020", "Unicef (2020). Lone.")} || 'b; ' || {_MARK("Du Bois et al., 2010b", "Du Bois, W., Zed, Y., & Xu, X. (2010b) Three")}
|| ', ' || {_MARK("Ärnst &amp; O''Neil 1999a", "Ärnst, B., &amp; O''Neil, C. (1999a). Two.")} || '.</p>' ELSE 'Unicef (2020) and Unicef 2020b; Du Bois et al., 2010b, Ärnst &amp; O''Neil 1999a.</p>' END || s_suppkey AS text FROM supplier""",
    "longest_forms": f"WITH {_FORMS} SELECT doc, string_agg(surface, '|' ORDER BY length(surface) DESC, encode(surface)) AS forms FROM s GROUP BY doc",
    "bibtex": """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE '@article{k' || p_partkey || ',' || chr(10) || '  author={Last, First and ' || p_name || '},' || chr(10) || '  title={{A, b}},' || chr(10) || '  year={2020}' || chr(10) || '}' END AS bib FROM part""",
    "registry_records": f"WITH {_REG} SELECT doi, title, authors, abstract FROM l",
    "under_review": f"""WITH {_REG}, s AS (SELECT p_partkey AS k, p_name, p_brand, p_type FROM part)
SELECT k::VARCHAR AS id, CASE WHEN k % 2 = 0 AND title IS NOT NULL THEN title ELSE CASE k % 4 WHEN 0 THEN '12 ' || p_name WHEN 1 THEN '12' WHEN 2 THEN 'Untitled submission' ELSE p_name END END AS title,
CASE WHEN k % 2 = 0 AND l.title IS NOT NULL THEN CASE k % 3 WHEN 0 THEN 'Ann ' || p_brand || ';Lee' ELSE 'Bo;Group' END WHEN k % 3 = 0 THEN p_brand ELSE '' END AS authors, CASE WHEN k % 2 = 0 THEN 'https://doi.org/10.1234/' || k ELSE 'none yet' END AS "preprintUrl",
CASE WHEN k % 2 = 0 THEN 'https://prereview.org/preprints/doi-10.1234-' || k || '/write-a-prereview' ELSE '' END AS "prereviewUrl", 'https://pubpeer.com/x' AS "pubpeerUrl", CASE WHEN k % 2 = 0 THEN coalesce(abstract, '') ELSE '' END AS "abstractHtml", '' AS "laySummary",
CASE k % 7 WHEN 0 THEN 'In review' WHEN 2 THEN 'Unpublished' ELSE 'Revision' END AS status, p_type AS "handlingEditor", CASE k % 3 WHEN 0 THEN '2024-' || lpad((k % 12 + 1)::VARCHAR, 2, '0') || '-05' WHEN 1 THEN 'soon' ELSE '' END AS "submissionDate"
FROM s JOIN l ON l.p_partkey = k WHERE k % 5 <> 2 AND k % 7 IN (0, 2, 5)""",
    "published_extras": """WITH s AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN '10.9/a' || p_partkey % 30 WHEN 2 THEN '10.9/b' || p_partkey ELSE '' END AS doi, CASE p_partkey % 4 WHEN 1 THEN 'https://www.a.org/' || p_partkey WHEN 3 THEN 'https://doi.org/10.5555/r' ELSE '' END AS peer, CASE WHEN p_partkey % 12 < 6 THEN 'http://d.org' ELSE '' END AS data FROM part)
SELECT doi, arg_max(peer, k) AS "peerReviewUrl", '' AS "reproCertUrl", arg_max(data, k) AS "dataUrl", '' AS "materialsUrl", '' AS "laySummary" FROM s WHERE doi <> '' AND (peer <> '' OR data <> '') GROUP BY doi""",
    "visible_blocks": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'c' ELSE 'b,c' END AS shown FROM nation",
    "names_and_fallbacks": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Ann ' || p_brand WHEN 1 THEN 'Ann' WHEN 2 THEN p_brand ELSE '' END AS joined, CASE p_partkey % 4 WHEN 0 THEN 'Ann ' || p_brand WHEN 1 THEN 'Ann' WHEN 2 THEN p_brand ELSE p_name END AS name,
CASE WHEN p_partkey % 4 = 3 THEN '17' ELSE p_name || '17' END AS "left", CASE WHEN p_partkey % 4 = 3 THEN '17' ELSE p_name END AS title, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 3 THEN NULL ELSE p_type END AS nonblank,
CASE WHEN p_partkey % 4 = 0 AND contains(p_name, 'a') THEN p_name WHEN p_partkey % 4 < 3 AND contains(p_type, 'a') THEN p_type END AS match, CASE WHEN p_partkey % 4 < 2 THEN 'Ann' ELSE p_name END AS fallback FROM part""",
    "namespaced_pages": """SELECT n_nationkey, '<p id="p' || n_nationkey || '--top">' || n_name || '</p><a href="#p' || n_nationkey || '--top">t</a><a href="#other">o</a><label for="p' || n_nationkey || '--top">l</label><i aria-controls="p' || n_nationkey || '--top"></i><script>document.getElementById(''p' || n_nationkey || '--top'')</script>' AS page,
n_name AS plain, '<a href="#home">h</a><a href="#a/b">b</a><a href="#part">p</a><a href="#a/' || n_name || '">v</a><a href="https://x/">x</a>' AS links FROM nation""",
    "regions": """SELECT n_nationkey, CASE WHEN f THEN '<p>' || n_name || '</p>' END AS main, CASE WHEN f THEN '<header class="site-header"><b>' || n_name || '</b></header>' END AS header, CASE WHEN f THEN '<footer class="site-footer"><p> <img src="l.png"> </p><p>rest</p><p><img src="m.png"></p></footer>' END AS footer,
CASE WHEN f THEN '<p> <img src="l.png"> </p>' END AS logo, CASE WHEN f THEN '<footer class="site-footer"><p>rest</p><p><img src="m.png"></p></footer>' END AS rest FROM (SELECT *, n_nationkey % 3 > 0 AS f FROM nation)""",
    "today": "SELECT r_regionkey, (current_date - 1)::DATE AS yesterday, strftime(timezone('UTC', now()), '%Y-%m-%d') AS day, ' UTC' AS zone FROM region",
    "json_round_trip": "SELECT c_custkey::VARCHAR AS id, c_name AS title, NULL::VARCHAR AS date, 'ä\"' || chr(10) AS html FROM customer",
    "keyed_json": "SELECT n_name AS id, n_nationkey AS \"ojsViews\", n_regionkey AS january, NULL::BIGINT AS \"pdfDownloads\" FROM nation",
    "item_lists": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 < 2 THEN n_name END AS date, CASE WHEN n_nationkey % 3 < 2 THEN '3' END AS value FROM nation",
    "sheet_round_trip": "SELECT c_custkey::VARCHAR AS c_custkey, c_name || ', \"q\"' || chr(10) || 'second' AS note, (c_acctbal * 100)::BIGINT AS cents FROM customer",
    "file_probe": """SELECT 'photo' AS kind, n_name AS slug, n_name || CASE WHEN n_nationkey % 3 = 0 THEN '.jpg' ELSE '.png' END AS file FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0
UNION ALL SELECT 'pdf', NULL, n_name || '.pdf' FROM nation WHERE n_nationkey % 4 > 0 UNION ALL SELECT 'new', NULL, n_name || '.pdf' FROM nation WHERE n_nationkey % 4 > 1""",
    "single_page": "SELECT string_agg('<p>' || n_name || '</p>', '' ORDER BY n_regionkey, n_nationkey) AS html FROM nation",
    "written_pages": "SELECT 'articles/' || n_nationkey || '/index.html' AS path, '<main>é ' || n_name || '</main>' AS content FROM nation",
    "inline_settings": "SELECT * FROM (VALUES ('A', 'x=1'), ('A2', 'z'), ('B', 'kept')) AS t(k, v)",
    "image_names": """SELECT p_partkey, CASE WHEN length(p_name) <= 9 THEN substr(sha1('https://x/i/' || p_name || '.png?s=1'), 1, 8) || '-' || replace(p_name, ' ', '_') || '.png' ELSE 'https://x/i/' || p_name || '.png?s=1' END AS src,
CASE WHEN length(p_name) <= 9 THEN 'data:image/png;base64,' || base64(encode(p_name)) END AS uri FROM part""",
}
