"""Index, search, join and dedupe queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators import joins, search, sections, site
from quillspark.plans.tables import table


def _index(spark, sf_dir):
    """Parts as articles: brand as section, type as category, size as year (10 of them without one)."""
    p = table(spark, sf_dir, "part")
    year = F.when(F.col("p_size") > 10, F.col("p_size") + 1990)
    articles = p.select(
        F.col("p_name").alias("title"), F.lit(None).cast("string").alias("subtitle"), F.col("p_partkey").cast("string").alias("urlPath"), F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).alias("section"),
        F.when(F.col("p_type") != "ECONOMY", F.array("p_type")).alias("categories"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("authors"),
        F.concat(year.cast("string"), F.lit("-01-01")).alias("datePublished"), F.lit(None).cast("long").alias("views"), F.col("p_partkey").alias("downloads"), F.col("p_partkey").alias("ord"),
    )
    return search.article_index(articles)


def _flat(df):
    return df.select("title", "subtitle", "url", "section", F.array_join("categories", ",").alias("categories"), F.array_join("authors", ",").alias("authors"), "year", "date", "views", "downloads", "ord")


def article_index(spark, sf_dir):
    return _flat(_index(spark, sf_dir))


def facet_search(spark, sf_dir):
    hits = search.facet_search(_index(spark, sf_dir), " RED ", ["Brand#2", "Brand#17", "Brand#5", ""], ["LARGE", "SMALL"], (2020, 2001))
    hits = _flat(hits)
    # a rank within its date, and the hits of later dates: only the counts of dates meet in one task
    dates = hits.groupBy("date").agg(F.count("*").alias("n"))
    before = dates.select(F.col("date").alias("d"), F.coalesce(F.sum("n").over(W.orderBy(F.desc("date")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = hits.join(before, F.col("date") == F.col("d")).withColumn("rank", (F.col("before") + F.row_number().over(W.partitionBy("date").orderBy("ord"))).cast("int"))
    return ranked.drop("d", "before")


def facet_all(spark, sf_dir):
    """All options chosen: the facets are off, and blank sections stay."""
    return _flat(search.facet_search(_index(spark, sf_dir), "widget", ["Brand#2"], [], None, n_sections=1, n_categories=0))


def facet_options(spark, sf_dir):
    o = search.facet_options(_index(spark, sf_dir))
    return o.select(F.array_join("sections", ",").alias("sections"), F.array_join("categories", ",").alias("categories"), "yearMin", "yearMax")


def facet_summary(spark, sf_dir):
    n = _index(spark, sf_dir).groupBy("section").agg(F.count("*").alias("n"), F.count_if(F.col("year").isNotNull()).alias("dated"))
    return n.select("section", search.facet_summary(F.col("dated"), F.col("n")).alias("label"), search.count_label(F.col("n")).alias("count_label"))


def left_default(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return joins.left_default(d, table(spark, sf_dir, "labels"), "doc_id", {"quality": -1}).select("doc_id", "lang", "quality", "toxic")


def dedupe_last(spark, sf_dir):
    return joins.keep_last(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn"])


def dedupe_first(spark, sf_dir):
    return joins.keep_first(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


def _tree(spark, sf_dir):
    s, n, r = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)


def nested_sort(spark, sf_dir):
    """Suppliers of each nation by balance descending, input order on ties, as a nested array and back to rows."""
    nested = joins.nest(table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey", [F.desc("s_acctbal"), F.asc("s_suppkey")], ["s_suppkey", "s_acctbal"], "items")
    return nested.select("n_nationkey", F.posexplode("items").alias("pos", "s")).select("n_nationkey", "pos", "s.s_suppkey", "s.s_acctbal")


def toc_groups(spark, sf_dir):
    g = sections.group_first_seen(_tree(spark, sf_dir).select("r_name", "n_name", "s_suppkey", "s_name"), "n_name", "s_suppkey", ["s_name"])
    return g.select("n_name", "first_ord", F.size("items").cast("long").alias("n"), F.element_at("items", 1)["s_name"].alias("first_name"))


def issue_counts(spark, sf_dir):
    return _tree(spark, sf_dir).groupBy("r_name").agg(F.count("s_suppkey").alias("articles"))


def dangling_keys(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    a = joins.dangling(orders, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k").select(F.lit("orders").alias("side"), "k")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"))
    b = joins.dangling(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k")), "k").select(F.lit("documents").alias("side"), "k")
    return a.unionByName(b)


def cascade(spark, sf_dir):
    """Document quality from labels, the number of characters as a second source, for the first 20 sources' rows."""
    keys = table(spark, sf_dir, "documents").select("doc_id")
    first = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("v"), F.lit("labels").alias("origin"))
    second = table(spark, sf_dir, "documents").where("lang <> 'en'").select("doc_id", F.col("n_chars").alias("v"), F.lit("documents").alias("origin"))
    return joins.cascade(keys, "doc_id", first, second)


def label_override(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("path"), "n_regionkey")
    labels = table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").cast("string").alias("path"), F.col("n_name").alias("label"))
    over = spark.createDataFrame([("3", "Who we are"), ("99", "Nowhere")], "path string, label string")
    return joins.label_override(n, over, labels).select("path", "label")


def nav_rows(spark, sf_dir):
    items = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("path"), F.col("n_name").alias("label"), F.col("n_nationkey").cast("long").alias("ord"))
    pages = table(spark, sf_dir, "region").where("r_regionkey <> 4").select(F.col("r_regionkey").cast("string").alias("slug"))
    about = spark.createDataFrame([("2", 0), ("0", 1), ("4", 2)], "path string, ord long")
    over = spark.createDataFrame([("0", "Our Network")], "path string, label string")
    return site.nav_rows(items, pages, about, over, spark.createDataFrame([("home", "/")], "path string, url string"))


def page_list(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("ord"), F.concat(F.lit("issues/"), "r_regionkey").alias("anchor"), F.col("r_name").alias("title"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), F.concat(F.lit("articles/"), "n_nationkey").alias("anchor"), F.col("n_name").alias("title"))
    return site.with_presence(site.page_list([(1, r), (2, n)]), r.select("anchor").where("ord < 3"), "anchor")


def limit_recent(spark, sf_dir):
    """The first three rows in source order."""
    return table(spark, sf_dir, "benchmark").orderBy("item_id").limit(3).select("item_id", F.substring("text", 1, 80).alias("head"))


def materials(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.concat(F.lit("https://a.example/"), "p_partkey")).alias("dataUrl"), F.when(F.col("p_type") == "LARGE", "https://b.example/").otherwise("").alias("materialsUrl"))
    lists = p.select("p_partkey", site.materials([("Data", "dataUrl"), ("Materials", "materialsUrl")]).alias("m"), site.pair_case(F.col("dataUrl"), F.col("materialsUrl"), "both", "data", "materials", "none").alias("shown"))
    return lists.select("p_partkey", "shown", F.array_join(F.transform("m", lambda x: F.concat(x["label"], F.lit("="), x["url"])), "|").alias("links"))


QUERIES = {f.__name__: f for f in (article_index, facet_search, facet_all, facet_options, facet_summary, left_default, dedupe_last, dedupe_first, nested_sort, toc_groups, issue_counts, dangling_keys, cascade, label_override, nav_rows, page_list, limit_recent, materials)}
_INDEX = """SELECT p_name AS title, '' AS subtitle, 'articles/' || p_partkey || '/' AS url, CASE WHEN p_brand <> 'Brand#1' THEN p_brand ELSE '' END AS section, CASE WHEN p_type <> 'ECONOMY' THEN p_type ELSE '' END AS categories, p_brand AS authors,
CASE WHEN p_size > 10 THEN p_size + 1990 END AS year, coalesce((CASE WHEN p_size > 10 THEN p_size + 1990 END)::VARCHAR || '-01-01', '') AS date, NULL::BIGINT AS views, p_partkey AS downloads, p_partkey AS ord FROM part"""
_TREE = "supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
SQL = {
    "article_index": _INDEX,
    "facet_search": f"""WITH i AS ({_INDEX}) SELECT *, row_number() OVER (ORDER BY date DESC, ord)::INTEGER AS rank FROM i WHERE contains(lower(title || ' ' || subtitle || ' ' || authors), 'red') AND section IN ('Brand#2', 'Brand#17', 'Brand#5', '')
AND (categories = '' OR categories IN ('LARGE', 'SMALL')) AND (year IS NULL OR year BETWEEN 2001 AND 2020)""",
    "facet_all": f"WITH i AS ({_INDEX}) SELECT * FROM i WHERE contains(lower(title || ' ' || subtitle || ' ' || authors), 'widget')",
    "facet_options": f"""WITH i AS ({_INDEX}) SELECT (SELECT string_agg(section, ',' ORDER BY section) FROM (SELECT DISTINCT section FROM i WHERE section <> '')) AS sections, (SELECT string_agg(categories, ',' ORDER BY categories) FROM (SELECT DISTINCT categories FROM i WHERE categories <> '')) AS categories,
coalesce(min(year), year(current_date))::INTEGER AS "yearMin", coalesce(max(year), year(current_date))::INTEGER AS "yearMax" FROM i""",
    "facet_summary": f"""WITH i AS ({_INDEX}), n AS (SELECT section, count(*) AS n, count(year) AS dated FROM i GROUP BY section)
SELECT section, CASE WHEN dated = n THEN '(all)' ELSE '(' || dated || '/' || n || ')' END AS label, n || ' ' || CASE WHEN n = 1 THEN 'article' ELSE 'articles' END AS count_label FROM n""",
    "left_default": "SELECT d.doc_id, lang, coalesce(quality, -1) AS quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "dedupe_last": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1",
    "dedupe_first": "SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1",
    "nested_sort": "SELECT s_nationkey AS n_nationkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1)::INTEGER AS pos, s_suppkey, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "toc_groups": f"SELECT n_name, min(s_suppkey) AS first_ord, count(*) AS n, arg_min(s_name, s_suppkey) AS first_name FROM {_TREE} GROUP BY n_name",
    "issue_counts": f"SELECT r_name, count(*) AS articles FROM {_TREE} GROUP BY r_name",
    "dangling_keys": "SELECT 'orders' AS side, o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'documents', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "cascade": """SELECT d.doc_id, coalesce(l.quality::BIGINT, CASE WHEN lang <> 'en' THEN n_chars END) AS v, CASE WHEN l.doc_id IS NOT NULL THEN 'labels' WHEN lang <> 'en' THEN 'documents' END AS origin FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "label_override": "SELECT n_nationkey::VARCHAR AS path, CASE WHEN n_nationkey = 3 THEN 'Who we are' ELSE n_name END AS label FROM nation WHERE n_nationkey = 3 OR n_regionkey <> 2",
    "nav_rows": """WITH f AS (SELECT n_regionkey AS k, arg_min(n_name, n_nationkey) AS label, min(n_nationkey)::BIGINT AS ord FROM nation GROUP BY 1), a AS (SELECT * FROM (VALUES (2, 0::BIGINT), (0, 1), (4, 2)) AS t(k, ord))
SELECT 0 AS grp, a.ord, CASE WHEN a.k = 0 THEN 'Our Network' ELSE f.label END AS label, a.k::VARCHAR AS path FROM a JOIN f ON f.k = a.k WHERE a.k IN (SELECT r_regionkey FROM region WHERE r_regionkey <> 4)
UNION ALL SELECT 1, f.ord, f.label, f.k::VARCHAR FROM f WHERE f.k NOT IN (SELECT k FROM a) AND f.k IN (SELECT r_regionkey FROM region WHERE r_regionkey <> 4)""",
    "page_list": "SELECT 1 AS grp, r_regionkey::BIGINT AS ord, 'issues/' || r_regionkey AS anchor, r_name AS title, r_regionkey < 3 AS present FROM region UNION ALL SELECT 2, n_nationkey::BIGINT, 'articles/' || n_nationkey, n_name, false FROM nation",
    "limit_recent": "SELECT item_id, substr(text, 1, 80) AS head FROM benchmark ORDER BY item_id LIMIT 3",
    "materials": """SELECT p_partkey, CASE WHEN p_size > 25 AND p_type = 'LARGE' THEN 'both' WHEN p_size > 25 THEN 'data' WHEN p_type = 'LARGE' THEN 'materials' ELSE 'none' END AS shown,
concat_ws('|', CASE WHEN p_size > 25 THEN 'Data=https://a.example/' || p_partkey END, CASE WHEN p_type = 'LARGE' THEN 'Materials=https://b.example/' END) AS links FROM part""",
}
