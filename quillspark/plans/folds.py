"""Sequential folds, layout analytics, dictionaries and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.text import dehyphenate, furniture_key
from quillspark.operators import citations, layout, sections
from quillspark.plans.tables import table
from quillspark.sources import sinks


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def unique_slug(spark, sf_dir):
    """Part names of each brand as headings in key order."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-").alias("slug"))
    return sections.simple_unique_slugs(p, ["p_brand"], "p_partkey", "slug")


def unique_slug_fold(spark, sf_dir):
    """The same by the exact fold; no name here ends in a number, so both rules agree."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-").alias("slug"))
    return sections.unique_slugs(p, ["p_brand"], "p_partkey", "slug")


def sections_fold(spark, sf_dir):
    """A user turn opens a section; turns before the first are dropped."""
    s = sections.sectionize(_turns(spark, sf_dir), ["conv_id"], "turn", F.col("role") == "user")
    return s.groupBy("conv_id", "section").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


def section_members(spark, sf_dir):
    """Sections with the assistant's turns as members and system turns as notes."""
    t, role = _turns(spark, sf_dir), F.col("role")
    s = sections.section_rows(t, ["conv_id"], "turn", role == "user", F.substring("text", 1, 20), F.when(role == "assistant", "list").otherwise("text"), "text")
    return s.select("conv_id", "section", "title", F.size("members").cast("long").alias("members"), F.length("note").cast("long").alias("note"))


def start_gate(spark, sf_dir):
    """Turns from the first system turn on; conversations without one stay whole."""
    return sections.start_gate(_turns(spark, sf_dir), ["conv_id"], "turn", F.col("role") == "system").select("conv_id", "turn")


def reference_gate(spark, sf_dir):
    """Turns whose last user or system turn is a system turn."""
    t, role = _turns(spark, sf_dir), F.col("role")
    return t.select("conv_id", "turn", sections.inside_gate(["conv_id"], "turn", role.isin("user", "system"), role == "system").alias("inside"))


def running_number(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", sections.running_number(["conv_id"], "turn", F.col("role") == "assistant").alias("n"))


def unique_slug_trap(spark, sf_dir):
    """Headings whose slugs equal made ones: a document a supplier, with up to seven of them."""
    slugs = ["a", "a-2", "a", "", "a-2", "a", "a-3"]
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), F.explode(F.sequence(F.lit(1), (F.col("s_suppkey") % 7 + 1).cast("int"))).alias("n"))
    return sections.unique_slugs(s.select("doc", "n", F.element_at(F.array(*map(F.lit, slugs)), F.col("n")).alias("slug")), ["doc"], "n", "slug")


def furniture_lines(spark, sf_dir):
    keys = F.transform(F.split("text", "\n"), furniture_key)
    return layout.document_lines_furniture(table(spark, sf_dir, "documents"), keys)


def weighted_mode(spark, sf_dir):
    """Language of most characters in each source, the first seen on a tie."""
    return layout.weighted_mode(table(spark, sf_dir, "documents"), ["source"], F.col("lang"), F.col("n_chars"), F.col("doc_id"))


def dehyphenated(spark, sf_dir):
    """Documents in lower case as paragraphs, with every full stop at a line's end made a hyphen to join at."""
    lines = F.transform(F.split(F.lower("text"), "\n"), lambda x: F.regexp_replace(x, "[.]$", "-"))
    return table(spark, sf_dir, "documents").select("doc_id", dehyphenate(lines).alias("paragraph"))


def dictionary_hits(spark, sf_dir):
    """Benchmark items, and their first three words, as a dictionary over all documents: an item's text wins over its
    beginning."""
    b = table(spark, sf_dir, "benchmark")
    phrases = b.select((F.col("item_id") * 2).alias("phrase_id"), F.col("text").alias("phrase")).unionByName(b.select((F.col("item_id") * 2 + 1).alias("phrase_id"), F.substring_index("text", " ", 3).alias("phrase")))
    return citations.dictionary_hits(table(spark, sf_dir, "documents"), phrases, "doc_id", "text", "phrase_id", "phrase")


def quality_gate(spark, sf_dir):
    """Failures of a few checks over documents and orders, side by side."""
    docs = sinks.gate_counts(table(spark, sf_dir, "documents"), {"no_text": F.col("text") != "", "short": F.length("text") >= 50, "lang": F.col("lang").isin("en", "de", "fr", "es")})
    orders = sinks.gate_counts(table(spark, sf_dir, "orders"), {"no_text": F.col("o_orderstatus") != "", "short": F.col("o_totalprice") >= 1000, "lang": F.col("o_custkey").isNotNull()})
    return docs.select(F.lit("documents").alias("t"), "*").unionByName(orders.select(F.lit("orders").alias("t"), "*"))


def peak_union(spark, sf_dir):
    """Days that have views or errors, as one sorted list per user: a distinct union of two key sets."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "error"))
    days = e.groupBy("user_id").agg(F.sort_array(F.collect_set(F.date_format("ts", "yyyy-MM-dd"))).alias("d"))
    return days.select("user_id", F.array_join("d", ",").alias("days"))


def series_peak(spark, sf_dir):
    """For each user, the days of two series together and the greatest value of either, one at least."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("ym"))
    n = e.groupBy("user_id", "ym").agg(F.count_if(F.col("event_type") == "view").alias("a"), F.count_if(F.col("event_type") == "purchase").alias("b"))
    return n.where("a + b > 0").groupBy("user_id").agg(F.count("*").alias("days"), F.greatest(F.max("a"), F.max("b"), F.lit(1)).alias("peak"))


QUERIES = {f.__name__: f for f in (unique_slug, unique_slug_fold, unique_slug_trap, sections_fold, section_members, start_gate, reference_gate, running_number, furniture_lines, weighted_mode, dehyphenated, dictionary_hits, quality_gate, peak_union, series_peak)}
_SLUG = """WITH p AS (SELECT p_partkey, p_brand, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS slug FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, slug ORDER BY p_partkey) AS n FROM p)
SELECT p_partkey, p_brand, slug, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS unique_slug FROM n"""
_SEC = "SELECT *, sum((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations"
SQL = {
    "unique_slug": _SLUG,
    "unique_slug_fold": _SLUG,
    "sections_fold": f"SELECT conv_id, section::BIGINT AS section, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM ({_SEC}) WHERE section > 0 GROUP BY ALL",
    "section_members": f"""SELECT * FROM (SELECT conv_id, section::BIGINT AS section, max(substr(text, 1, 20)) FILTER (role = 'user') AS title, count(*) FILTER (role = 'assistant') AS members, coalesce(sum(length(text)) FILTER (role = 'system'), 0)::BIGINT AS note FROM ({_SEC}) WHERE section > 0 GROUP BY ALL)
WHERE members > 0 OR note > 0""",
    "start_gate": """SELECT conv_id, turn FROM (SELECT *, max((role = 'system')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) AS s, max((role = 'system')::INTEGER) OVER (PARTITION BY conv_id) AS a FROM conversations) WHERE s = 1 OR a = 0""",
    "reference_gate": """SELECT conv_id, turn, coalesce(last_value(CASE WHEN role IN ('user', 'system') THEN role = 'system' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS inside FROM conversations""",
    "running_number": "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN sum((role = 'assistant')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) END::BIGINT AS n FROM conversations",
    "furniture_lines": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT DISTINCT doc_id, regexp_replace(regexp_replace(lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))), '^[\\s\\d|·•—–-]+', ''), '[\\s\\d|·•—–-]+$', '') AS key FROM l)
SELECT key, count(*) AS n FROM k WHERE key <> '' GROUP BY key HAVING count(*) >= 3""",
    "weighted_mode": """WITH s AS (SELECT source, lang, sum(n_chars)::BIGINT AS w, min(doc_id) AS f FROM documents GROUP BY ALL)
SELECT source, lang AS mode, w AS weight FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY w DESC, f) AS k FROM s) WHERE k = 1""",
    "unique_slug_trap": """SELECT doc, n::INTEGER AS n, ['a', 'a-2', 'a', '', 'a-2', 'a', 'a-3'][n] AS slug, ['a', 'a-2', 'a-3', 'section-3', 'a-2-2', 'a-4', 'a-3-2'][n] AS unique_slug FROM (SELECT s_suppkey AS doc, unnest(range(1, s_suppkey % 7 + 2)) AS n FROM supplier)""",
    "dehyphenated": """WITH l AS (SELECT doc_id, array_to_string([trim(regexp_replace(x, '[.]$', '-')) for x in string_split(lower(text), chr(10)) if trim(x) <> ''], chr(10)) AS t FROM documents),
j AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(\\p{L})-\\n(\\p{Ll})', '\\1\\2', 'g'), '(\\p{L})-\\n(\\p{Ll})', '\\1\\2', 'g'), '(\\p{L})-\\n(\\p{Ll})', '\\1\\2', 'g') AS t FROM l)
SELECT doc_id, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS paragraph FROM j""",
    "dictionary_hits": """WITH p AS (SELECT item_id * 2 AS phrase_id, text AS phrase FROM benchmark UNION ALL SELECT item_id * 2 + 1, array_to_string(string_split(text, ' ')[1:3], ' ') FROM benchmark),
a AS (SELECT string_agg(regexp_escape(phrase), '|' ORDER BY length(phrase) DESC) AS pattern FROM (SELECT DISTINCT phrase FROM p)),
h AS (SELECT doc_id, unnest(regexp_extract_all(text, (SELECT pattern FROM a))) AS phrase FROM documents)
SELECT doc_id, phrase_id, count(*) AS n FROM h JOIN p USING (phrase) GROUP BY doc_id, phrase_id""",
    "quality_gate": """SELECT 'documents' AS t, count(*) FILTER (text IS NULL OR text = '') AS no_text, count(*) FILTER (text IS NULL OR length(text) < 50) AS short, count(*) FILTER (lang IS NULL OR lang NOT IN ('en', 'de', 'fr', 'es')) AS lang, count(*) AS rows FROM documents
UNION ALL SELECT 'orders', count(*) FILTER (o_orderstatus IS NULL OR o_orderstatus = ''), count(*) FILTER (o_totalprice IS NULL OR o_totalprice < 1000), count(*) FILTER (o_custkey IS NULL), count(*) FROM orders""",
    "series_peak": """WITH n AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS d, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'purchase') AS b FROM events GROUP BY ALL)
SELECT user_id, count(*) AS days, greatest(max(a), max(b), 1)::BIGINT AS peak FROM n WHERE a + b > 0 GROUP BY user_id""",
    "peak_union": "SELECT user_id, string_agg(d, ',' ORDER BY d) AS days FROM (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS d FROM events WHERE event_type IN ('view', 'error')) GROUP BY user_id",
}
