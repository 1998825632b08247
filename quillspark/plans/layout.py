"""Layout analytics over pages made from the parts: part k is a document of k % 9 + 1 blocks, two a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import numbers
from quillspark.functions.text import spaced_join
from quillspark.operators import layout
from quillspark.plans.tables import spread, table

#: What stands in block n of a document: text of its last span, size, flags, top, font, and the text and size of a span before.
BLOCKS = [
    ("Introduction", 14.0, 16, 50.0, "Serif", "", 0.0),
    ("Plain words of the body that go on for a while", 10.04, 0, 100.0, "Serif", "", 0.0),
    (" A note at the foot.", 8.0, 0, 600.0, "Serif", "1", 6.0),
    ("Figure 1 A caption", 9.0, 0, 400.0, "Serif", "", 0.0),
    ("x = y", 10.0, 0, 450.0, "CMMI10", "", 0.0),
    ("References", 14.0, 16, 50.0, "Serif", "", 0.0),
    ("Smith, A. (2020). A reference.", 10.0, 0, 100.0, "Serif", "", 0.0),
    ("Appendix", 10.0, 0, 50.0, "Serif", "", 0.0),
    ("17", 10.0, 0, 700.0, "Serif", "", 0.0),
]


def _blocks(spark, sf_dir):
    """All rows of a document are in one task from here on: what is grouped or joined by document needs no exchange."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("doc")), "doc")
    p = p.select("doc", F.explode(F.sequence(F.lit(1), (F.col("p_partkey") % len(BLOCKS) + 1).cast("int"))).alias("n"))
    at = lambda i: F.element_at(F.array(*[F.lit(b[i]) for b in BLOCKS]), F.col("n"))
    return p.select("doc", "n", F.floor((F.col("n") - 1) / 2).cast("int").alias("page"), *[at(i).alias(c) for i, c in enumerate(("text", "size", "flags", "y0", "font", "lead_text", "lead_size"))])


def _spans(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    place = ["doc", "page", F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h"), F.col("n").alias("block"), F.lit(0).alias("block_type"), F.lit(0).alias("line")]
    box = [F.lit(50.0).alias("x0"), "y0", F.lit(500.0).alias("x1"), (F.col("y0") + 20).alias("y1")]
    span = lambda n, text, size, flags: F.struct(F.lit(n).alias("span"), F.col(text).alias("text"), F.col(size).alias("size"), flags.alias("flags"))
    whole, lead = span(1, "text", "size", F.col("flags")), span(0, "lead_text", "lead_size", F.lit(0))
    return b.select(*place, "font", *box, F.inline(F.when(F.col("lead_text") != "", F.array(whole, lead)).otherwise(F.array(whole))))


def _boxes(b, boxes):
    """The boxes (page, x0, y0, x1, y1) of each row, as far as they are not NULL."""
    box = lambda page, *at: F.struct(page.alias("page"), *[F.lit(v).alias(c) for v, c in zip(at, ("x0", "y0", "x1", "y1"), strict=True)])
    return b.select("doc", F.inline(F.array_compact(F.array(*[F.when(when, box(*at)) for when, *at in boxes]))))


def _images(spark, sf_dir):
    """An image above the caption of each document that has one, and a large one on the next page of every second."""
    page, all_of_them = F.col("page"), F.lit(True)
    second = F.col("doc").cast("int") % 2 == 0
    return _boxes(_blocks(spark, sf_dir).where("n = 4"), [(all_of_them, page, 100.0, 150.0, 400.0, 350.0), (second, page + 1, 100.0, 200.0, 400.0, 300.0), (all_of_them, page + 1, 100.0, 500.0, 400.0, 520.0)])


def _drawings(spark, sf_dir):
    """Beside the image a drawing that is large enough, and a rule that is not."""
    page, all_of_them = F.col("page"), F.lit(True)
    return _boxes(_blocks(spark, sf_dir).where("n = 4"), [(all_of_them, page, 420.0, 300.0, 480.0, 380.0), (all_of_them, page, 10.0, 20.0, 590.0, 21.0)])


def _bookmarks(spark, sf_dir):
    b = _blocks(spark, sf_dir).where("n IN (1, 8)")
    return b.select("doc", F.upper("text").alias("title"), F.col("n").alias("ord"), F.when(F.col("n") == 1, 1).otherwise(2).alias("level"))


def layout_body(spark, sf_dir):
    return layout.body_size(_spans(spark, sf_dir))


def layout_blocks(spark, sf_dir):
    """Text, dominant style, share of maths and first span of each block."""
    b = layout.block_rows(_spans(spark, sf_dir))
    return b.select("doc", "page", "block", "text", "size", "bold", "math_share", F.col("lead.text").alias("lead"), F.col("lead.size").alias("lead_size"))


def layout_furniture(spark, sf_dir):
    """Headers of the pages of orders: an order's key is no furniture, the customer's is where three pages have it."""
    o = table(spark, sf_dir, "orders")
    b = o.select(F.col("o_orderstatus").alias("doc"), F.col("o_orderkey").alias("page"), F.concat(F.lit("12 | Customer "), "o_custkey", F.lit(" of the shop | 7")).alias("text"))
    return layout.furniture(b)


def layout_footnote_markers(spark, sf_dir):
    s = _spans(spark, sf_dir)
    return layout.footnote_markers(layout.block_rows(s), layout.body_size(s)).select("doc", "page", F.array_join("markers", ",").alias("markers"))


def layout_figures(spark, sf_dir):
    blocks = layout.block_rows(_spans(spark, sf_dir))
    return layout.figure_regions(blocks, _images(spark, sf_dir), _drawings(spark, sf_dir), layout.furniture(blocks))


def layout_standalone(spark, sf_dir):
    blocks = layout.block_rows(_spans(spark, sf_dir))
    images = _images(spark, sf_dir)
    return layout.standalone_images(images, layout.figure_regions(blocks, images, _drawings(spark, sf_dir), layout.furniture(blocks))).select("doc", "page", "x0", "y0", "x1", "y1")


def layout_classes(spark, sf_dir):
    """Headings, footnotes, captions, what lies inside figures, equations and paragraphs, in reading order."""
    c = layout.classified(_spans(spark, sf_dir), _images(spark, sf_dir), _drawings(spark, sf_dir), _bookmarks(spark, sf_dir))
    return c.select("doc", "page", "block", "kind", "level", "text", "figure_no", "marker")


def layout_full_text(spark, sf_dir):
    """The classified blocks as HTML, one row a document."""
    s = _spans(spark, sf_dir)
    return layout.full_text(layout.classified(s, _images(spark, sf_dir), _drawings(spark, sf_dir), _bookmarks(spark, sf_dir)))


def footnotes_resolved(spark, sf_dir):
    """Marks of line items with the note of their order's page: of notes that repeat a mark the last counts."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"), (F.col("l_partkey") % 3).cast("string").alias("marker")).distinct()
    notes = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("doc"), (F.col("p_partkey") % 4 + 1).cast("int").alias("page"), F.lit("1").alias("marker"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("text"))
    return layout.resolved_footnotes(li, notes)


def spaced_lines(spark, sf_dir):
    """Lines of spans whose style changes between words, beside signs, and at an empty span."""
    c = table(spark, sf_dir, "customer")
    span = lambda t, style: F.struct((F.lit(t) if t is not None else F.col("c_mktsegment")).alias("text"), F.lit(style).alias("style"))
    spans = F.array(span(None, "a"), span("bold", "b"), span("", "c"), span("more", "b"), span(", ", "a"), span("end", "b"), span("é", "c"), span(".", "b"))
    return c.select("c_custkey", spaced_join(spans).alias("line"))


def rect_forms(spark, sf_dir):
    """Boxes made from order numbers: whether they meet, what they share, and what holds both."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", *[(F.col("o_orderkey") * k % m).cast("double").alias(c) for c, k, m in (("a", 7, 40), ("b", 11, 30), ("c", 13, 40), ("d", 17, 30))])
    one, two = tuple(map(F.col, ("a", "b"))) + (F.col("a") + 10, F.col("b") + 8), tuple(map(F.col, ("c", "d"))) + (F.col("c") + 12, F.col("d") + 5)
    named = lambda name, r: [x.alias(f"{name}{i}") for i, x in enumerate(r)]
    return o.select("o_orderkey", numbers.intersects(one, two).alias("meet"), *named("clip", numbers.clip(one, two)), *named("union", numbers.union(one, two)))


def all_rects(spark, sf_dir):
    """The box around all boxes of a customer."""
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 40).cast("double").alias("x0"), (F.col("o_orderkey") % 30).cast("double").alias("y0"))
    return numbers.union_all(o.withColumns({"x1": F.col("x0") + 10, "y1": F.col("y0") + 8}), ["o_custkey"])


def tenths(spark, sf_dir):
    """To one decimal, halves to even: eighths and quarters of order numbers."""
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.tenth((F.col("o_orderkey") * 25).cast("decimal(12,0)") / F.lit(100).cast("decimal(3,0)")).cast("double").alias("t"))


QUERIES = {f.__name__: f for f in (layout_body, layout_blocks, layout_furniture, layout_footnote_markers, layout_figures, layout_standalone, layout_classes, layout_full_text, footnotes_resolved, spaced_lines, rect_forms, all_rects, tenths)}

_Q = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
_B = (
    "b AS (SELECT p.doc, p.n, (p.n - 1) // 2 AS page, v.* FROM (SELECT p_partkey::VARCHAR AS doc, p_partkey AS k, unnest(range(1, p_partkey % 9 + 2)) AS n FROM part) p JOIN (VALUES "
    + ", ".join(f"({i + 1}, {', '.join(_Q(x) for x in b)}, {round(b[1], 1)})" for i, b in enumerate(BLOCKS))
    + ") AS v(i, t, size, flags, y0, font, lead_text, lead_size, tenth) ON v.i = p.n)"
)
# the size of most characters: block 2 has most of them wherever it is, so only documents of one block differ
_BODY = "body AS (SELECT doc, CASE WHEN max(n) = 1 THEN 14.0 ELSE 10.0 END AS body FROM b GROUP BY doc)"
# what reading order keeps: no page number, nothing before the heading that is the first bookmark, nothing of the references
_KIND = f"""{_B}, {_BODY}, c AS (SELECT b.*, body, n IN (1, 8) OR (n = 6 AND 14.0 >= body + 1) AS heading FROM b JOIN body USING (doc) WHERE n <> 9),
k AS (SELECT doc, page::INTEGER AS page, n::INTEGER AS block, CASE WHEN n = 3 THEN 'footnote' WHEN n = 4 THEN 'figure' WHEN n = 5 THEN 'equation' WHEN heading THEN 'heading' ELSE 'paragraph' END AS kind,
CASE WHEN heading THEN CASE WHEN n = 8 THEN 2 ELSE 1 END END AS level, CASE WHEN n = 3 THEN '1 A note at the foot.' ELSE t END AS text, CASE WHEN n IN (4, 5) THEN n - 3 END::BIGINT AS figure_no, CASE WHEN n = 3 THEN '1' END AS marker FROM c WHERE n NOT IN (6, 7))"""
_ESC = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
SQL = {
    "layout_body": f"WITH {_B}, {_BODY} SELECT doc, body::DOUBLE AS body FROM body",
    "layout_blocks": f"""WITH {_B} SELECT doc, page::INTEGER AS page, n::INTEGER AS block, trim(lead_text || t) AS text, tenth::DOUBLE AS size, flags = 16 AS bold, CASE WHEN n = 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS math_share,
CASE WHEN lead_text <> '' THEN lead_text ELSE t END AS lead, CASE WHEN lead_text <> '' THEN lead_size ELSE size END::DOUBLE AS lead_size FROM b""",
    "layout_furniture": "SELECT o_orderstatus AS doc, 'customer ' || o_custkey || ' of the shop' AS key, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) >= 3",
    "layout_footnote_markers": f"WITH {_B} SELECT doc, page::INTEGER AS page, '1' AS markers FROM b WHERE n = 3",
    "layout_figures": f"WITH {_B} SELECT doc, page::INTEGER AS page, n::INTEGER AS block, 96.0::DOUBLE AS x0, 146.0::DOUBLE AS y0, 484.0::DOUBLE AS x1, 384.0::DOUBLE AS y1 FROM b WHERE n = 4",
    "layout_standalone": f"WITH {_B} SELECT doc, (page + 1)::INTEGER AS page, 100.0::DOUBLE AS x0, 200.0::DOUBLE AS y0, 400.0::DOUBLE AS x1, 300.0::DOUBLE AS y1 FROM b WHERE n = 4 AND doc::INTEGER % 2 = 0",
    "layout_classes": f"WITH {_KIND} SELECT * FROM k",
    "layout_full_text": f"""WITH {_KIND} SELECT doc, string_agg(CASE kind WHEN 'heading' THEN '<h' || (level + 1) || '>' || {_ESC} || '</h' || (level + 1) || '>' WHEN 'footnote' THEN '<aside class="footnote" data-marker="1">' || {_ESC} || '</aside>'
WHEN 'figure' THEN '<figure data-no="' || figure_no || '"><figcaption>' || {_ESC} || '</figcaption></figure>' WHEN 'equation' THEN '<figure data-no="' || figure_no || '"></figure>' ELSE '<p>' || {_ESC} || '</p>' END, chr(10) ORDER BY block) AS html,
count(*) FILTER (kind = 'heading') AS headings, count(*) FILTER (kind = 'footnote') AS footnotes, count(*) FILTER (kind IN ('figure', 'equation')) AS figures FROM k GROUP BY doc""",
    "footnotes_resolved": """WITH r AS (SELECT DISTINCT l_suppkey AS doc, l_linenumber AS page, (l_partkey % 3)::VARCHAR AS marker FROM lineitem), n AS (SELECT p_partkey % 50 AS doc, p_partkey % 4 + 1 AS page, '1' AS marker, arg_max(p_name, p_partkey) AS body FROM part GROUP BY ALL)
SELECT r.doc, r.page, r.marker, n.body FROM r LEFT JOIN n ON n.doc = r.doc AND n.page = r.page AND n.marker = r.marker""",
    "spaced_lines": "SELECT c_custkey, c_mktsegment || ' boldmore, end é.' AS line FROM customer",
    "rect_forms": """WITH o AS (SELECT o_orderkey, (o_orderkey * 7 % 40)::DOUBLE AS a, (o_orderkey * 11 % 30)::DOUBLE AS b, (o_orderkey * 13 % 40)::DOUBLE AS c, (o_orderkey * 17 % 30)::DOUBLE AS d FROM orders)
SELECT o_orderkey, a < c + 12 AND c < a + 10 AND b < d + 5 AND d < b + 8 AS meet, greatest(a, c) AS clip0, greatest(b, d) AS clip1, least(a + 10, c + 12) AS clip2, least(b + 8, d + 5) AS clip3, least(a, c) AS union0, least(b, d) AS union1, greatest(a + 10, c + 12) AS union2, greatest(b + 8, d + 5) AS union3 FROM o""",
    "all_rects": "SELECT o_custkey, min(o_orderkey % 40)::DOUBLE AS x0, min(o_orderkey % 30)::DOUBLE AS y0, max(o_orderkey % 40 + 10)::DOUBLE AS x1, max(o_orderkey % 30 + 8)::DOUBLE AS y1 FROM orders GROUP BY o_custkey",
    "tenths": "SELECT o_orderkey, CASE o_orderkey * 25 % 100 WHEN 0 THEN o_orderkey // 4 WHEN 25 THEN o_orderkey // 4 + 0.2 WHEN 50 THEN o_orderkey // 4 + 0.5 ELSE o_orderkey // 4 + 0.8 END::DOUBLE AS t FROM orders",
}
