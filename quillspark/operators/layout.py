"""Layout analytics on a span table: doc, page, page_w, page_h, block, block_type, line, span, text, size, flags, font,
x0, y0, x1, y1 (the box is that of the block)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.ids import strip
from quillspark.functions.numbers import clip, intersects, tenth
from quillspark.functions.text import dehyphenate, furniture_key, norm
from quillspark.operators.joins import keep_last, merged
from quillspark.operators.sections import inside_gate, running_number, start_gate

# Style flag, thresholds and patterns of the rules below
BOLD = 16
DEFAULT_SIZE, FURNITURE_PAGES = 11.0, 3
FIGURE_W, FIGURE_H, DRAWING_W, DRAWING_H = 100, 60, 40, 25
MARKER_DELTA, BODY_DELTA_MIN, BODY_DELTA_MAX, FOOT_FRACTION = 2.5, 0.5, 4.0, 0.55
CAPTION = r"(?i)^(Figure|Fig\.|Table)\s*\d+"
PAGE_NUMBER = r"^\d{1,3}$"
MATH_FONT = "CM[A-Z]|Math|Symbol|MSAM|MSBM|MJX"
MARKER = r"^(\d{1,3})[.)]?$"
REFERENCE_HEADINGS = ("references", "bibliography", "literature", "literatur")
BULLETS = "•‣▪✦◦·*–—-"


def weighted_mode(df: DataFrame, keys: list[str], value: Column, weight: Column, order: Column) -> DataFrame:
    """Value of the largest total weight per key; on a tie the one seen first."""
    sums = df.groupBy(*keys, value.alias("mode")).agg(F.sum(weight).alias("w"), F.min(order).alias("first"))
    best = F.max_by(F.struct("mode", "w"), F.struct("w", (-F.col("first")).alias("back")))
    return sums.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.mode").alias("mode"), F.col("b.w").alias("weight"))


def _place() -> Column:
    return F.col("page") * 10_000_000_000 + F.col("block") * 1_000_000 + F.col("line") * 1000 + F.col("span")


def body_size(spans: DataFrame) -> DataFrame:
    """(doc, body): the font size of most characters; 11.0 where there are none."""
    sized = (F.col("block_type") == 0) & F.col("doc").isNotNull()
    sums = spans.groupBy("doc", sized.alias("sized"), F.when(sized, tenth(F.col("size"))).alias("mode")).agg(F.sum(F.length("text")).alias("w"), F.min(_place()).alias("first"))
    best = F.max_by("mode", F.when(F.col("sized"), F.struct("w", (-F.col("first")).alias("back"))))
    return sums.groupBy("doc").agg(F.coalesce(best, F.lit(DEFAULT_SIZE)).alias("body"))


def block_rows(spans: DataFrame) -> DataFrame:
    """One row per text block: its text, its dominant style, its share of maths characters, its first span, its box."""
    key = ["doc", "page", "block"]
    s = spans.where("block_type = 0 AND doc IS NOT NULL AND page IS NOT NULL AND block IS NOT NULL")
    n, boxes = F.length(strip(F.col("text"))), ("page_w", "page_h", "x0", "y0", "x1", "y1")
    style = F.struct(tenth(F.col("size")).alias("size"), (F.col("flags").bitwiseAND(BOLD) != 0).alias("bold"))
    sums = (F.sum(F.when(F.col("font").rlike(MATH_FONT), n).otherwise(0)).alias("m"), F.sum(n).alias("n"))
    lines = s.groupBy(*key, "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda x: x["text"]), "").alias("t"), *[F.first(c).alias(c) for c in boxes],
        F.min_by(F.struct("text", "size"), F.struct("span")).alias("lead"), *sums, F.collect_list(F.when(n > 0, F.struct(style.alias("style"), n.alias("n"), _place().alias("at")))).alias("styles"),
    )
    b = lines.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]).alias("lines"), *[F.first(c).alias(c) for c in boxes],
        F.min_by("lead", F.struct("line")).alias("lead"), F.sum("m").alias("m"), F.sum("n").alias("n"), F.flatten(F.collect_list("styles")).alias("styles"),
    )
    b = b.select(*key, dehyphenate(F.col("lines")).alias("text"), _mode(F.col("styles")).alias("mode"), "m", "n", "lead", *boxes)
    size, bold = F.coalesce("mode.size", F.lit(0.0)).alias("size"), F.coalesce("mode.bold", F.lit(False)).alias("bold")
    return b.select(*key, "text", size, bold, F.when(F.col("n") > 0, F.col("m") / F.col("n")).otherwise(0.0).alias("math_share"), "lead", *boxes)


def _mode(styles: Column) -> Column:
    """weighted_mode of an array of (style, n, at), NULL for an empty one."""

    def weighed(style):
        own = F.filter(styles, lambda x: x["style"].eqNullSafe(style))
        w = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x["n"])
        return F.struct(w.alias("w"), (-F.array_min(F.transform(own, lambda x: x["at"]))).alias("back"), style.alias("style"))

    return F.array_max(F.transform(F.array_distinct(F.transform(styles, lambda x: x["style"])), weighed))["style"]


def furniture(blocks: DataFrame, pages: int = FURNITURE_PAGES) -> DataFrame:
    """(doc, key, n): block texts that `pages` or more pages of a document repeat."""
    keyed = blocks.select("doc", "page", furniture_key(F.col("text")).alias("key")).where("key <> ''")
    return keyed.groupBy("doc", "key").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= pages)


def leading_marker(body: Column) -> Column:
    """Number of a footnote that a block starts with, NULL without one."""
    small = F.col("lead.size") <= body - MARKER_DELTA
    return F.when(small, F.nullif(F.regexp_extract(strip(F.col("lead.text")), MARKER, 1), F.lit("")))


def footnote_like(body: Column) -> Column:
    low = F.col("y0") >= F.col("page_h") * FOOT_FRACTION
    return leading_marker(body).isNotNull() & low & ~F.col("bold") & F.col("size").between(body - BODY_DELTA_MAX, body - BODY_DELTA_MIN)


def footnote_markers(blocks: DataFrame, bodies: DataFrame) -> DataFrame:
    """(doc, page, markers): confirmed footnote numbers; pages without any are absent."""
    b = blocks.join(merged(bodies), "doc").where(footnote_like(F.col("body")))
    return b.groupBy("doc", "page").agg(F.sort_array(F.collect_set(leading_marker(F.col("body")))).alias("markers"))


def heading(body: Column, listed: Column) -> Column:
    t = F.col("text")
    big = F.col("bold") & (F.col("size") >= body + 1)
    return (big | listed) & (F.length(t) < 120) & ~F.substring(t, 1, 1).isin(*BULLETS) & ~t.endswith(".")


def figure_regions(blocks: DataFrame, images: DataFrame, drawings: DataFrame, furniture_keys: DataFrame) -> DataFrame:
    """(doc, page, block, x0..y1): the region above each caption, as far as it is large enough.

    The band above a caption ends at the nearest wide text block. Images and larger drawings in the band make up the
    region. All joins are on (doc, page), so a page's rows meet only each other.
    """
    key = ["doc", "page"]
    text = blocks.withColumn("key", furniture_key(F.col("text"))).where("key <> ''").join(merged(furniture_keys.select("doc", "key")), ["doc", "key"], "left_anti")
    captions = blocks.where(F.col("text").rlike(CAPTION)).select(*key, "block", "page_w", F.col("y0").alias("cy"))
    wide = text.where((F.col("x1") - F.col("x0")) > F.col("page_w") * 0.5).select(*key, F.col("y1").alias("wy"))
    top = captions.join(merged(wide), key, "left").groupBy(*key, "block", "page_w", "cy").agg(F.coalesce(F.max(F.when(F.col("wy") <= F.col("cy") - 4, F.col("wy"))), F.lit(0.0)).alias("top"))
    large = drawings.where((F.col("x1") - F.col("x0") >= DRAWING_W) & (F.col("y1") - F.col("y0") >= DRAWING_H))
    parts = images.select(*key, "x0", "y0", "x1", "y1").unionByName(large.select(*key, "x0", "y0", "x1", "y1"))
    band = (F.lit(0.0), F.col("top"), F.col("page_w"), F.col("cy"))
    box = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))
    met = top.join(merged(parts), key).where(intersects(box, band)).groupBy(*key, "block", "page_w", "cy", "top").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    x0, y0, x1, y1 = clip(box, band)
    cut = met.select(*key, "block", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    cut = cut.where((F.col("x1") - F.col("x0") >= FIGURE_W) & (F.col("y1") - F.col("y0") >= FIGURE_H))
    return cut.select(*key, "block", (F.col("x0") - 4).alias("x0"), (F.col("y0") - 4).alias("y0"), (F.col("x1") + 4).alias("x1"), (F.col("y1") + 4).alias("y1"))


def standalone_images(images: DataFrame, figures: DataFrame) -> DataFrame:
    """Large images that meet no captioned figure."""
    key = ["doc", "page"]
    big = images.where((F.col("x1") - F.col("x0") >= FIGURE_W) & (F.col("y1") - F.col("y0") >= FIGURE_H))
    f = figures.select(*key, *[F.col(c).alias("f" + c) for c in ("x0", "y0", "x1", "y1")])
    meets = (F.col("x0") < F.col("fx1")) & (F.col("fx0") < F.col("x1")) & (F.col("y0") < F.col("fy1")) & (F.col("fy0") < F.col("y1"))
    return big.alias("i").join(merged(f).alias("f"), (F.col("i.doc") == F.col("f.doc")) & (F.col("i.page") == F.col("f.page")) & meets, "left_anti")


def classified(spans: DataFrame, images: DataFrame, drawings: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Text blocks in reading order with their class: heading, footnote, figure, inside_figure, equation or paragraph.

    Blank blocks, furniture and page numbers are dropped, and so is what precedes the heading that is the first bookmark
    (unless no heading is) and what follows a heading of the reference list up to the next heading.
    """
    blocks, bodies = block_rows(spans), body_size(spans)
    repeated = furniture(blocks)
    b = blocks.withColumn("norm", norm(F.col("text"))).withColumn("key", furniture_key(F.col("text")))
    b = b.where(~F.col("text").rlike(PAGE_NUMBER) & (F.col("norm") != "")).join(merged(repeated.select("doc", "key")), ["doc", "key"], "left_anti").join(merged(bodies), "doc")
    marks = bookmarks.withColumn("norm", norm(F.col("title")))
    titles = keep_last(marks.select("doc", "norm", "ord", "level"), ["doc", "norm"], ["ord"]).select("doc", "norm", "level")
    first = marks.groupBy("doc").agg(F.min_by("norm", "ord").alias("first_heading"))
    b = b.join(merged(titles), ["doc", "norm"], "left").join(merged(first), "doc", "left")
    b = b.withColumn("ord", F.col("page") * 1_000_000 + F.col("block")).withColumn("is_heading", heading(F.col("body"), F.col("level").isNotNull()))
    b = start_gate(b, ["doc"], "ord", F.coalesce(F.col("is_heading") & (F.col("norm") == F.col("first_heading")), F.lit(False)))
    b = b.withColumn("in_references", inside_gate(["doc"], "ord", F.col("is_heading"), F.col("norm").isin(*REFERENCE_HEADINGS))).where("NOT in_references")
    figures = figure_regions(blocks, images, drawings, repeated)
    box = figures.groupBy("doc", "page").agg(F.collect_list(F.struct("block", "x0", "y0", "x1", "y1")).alias("regions"))
    b = b.join(merged(box), ["doc", "page"], "left").withColumn("is_figure", F.exists("regions", lambda r: r["block"] == F.col("block")))
    meets = lambda r: (F.col("x0") < r["x1"]) & (r["x0"] < F.col("x1")) & (F.col("y0") < r["y1"]) & (r["y0"] < F.col("y1"))
    inside = F.coalesce(F.exists("regions", meets), F.lit(False))
    kind = (
        F.when(~F.col("is_heading") & footnote_like(F.col("body")), "footnote").when(F.col("is_figure"), "figure").when(inside, "inside_figure").when((F.col("math_share") > 0.5) & ~F.col("is_heading"), "equation").when(F.col("is_heading"), "heading").otherwise("paragraph")
    )
    out = b.withColumn("kind", kind).withColumn("level", F.when(F.col("is_heading"), F.coalesce("level", F.lit(1))))
    out = out.withColumn("figure_no", running_number(["doc"], "ord", F.col("kind").isin("figure", "equation")))
    return out.select("doc", "page", "block", "ord", "kind", "level", "text", "figure_no", leading_marker(F.col("body")).alias("marker"))


def block_html() -> Column:
    """HTML of a classified block; a figure's image is left to whoever renders it, and what lies inside one is part of it."""
    t = F.col("text")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(char), F.lit(name))
    tag = F.concat(F.lit("h"), F.least(F.col("level") + 1, F.lit(6)).cast("string"))
    figure = lambda inside: F.concat(F.lit('<figure data-no="'), F.col("figure_no").cast("string"), F.lit('">'), inside, F.lit("</figure>"))
    return (
        F.when(F.col("kind") == "heading", F.concat(F.lit("<"), tag, F.lit(">"), t, F.lit("</"), tag, F.lit(">"))).when(F.col("kind") == "footnote", F.concat(F.lit('<aside class="footnote" data-marker="'), "marker", F.lit('">'), t, F.lit("</aside>")))
        .when(F.col("kind") == "figure", figure(F.concat(F.lit("<figcaption>"), t, F.lit("</figcaption>")))).when(F.col("kind") == "equation", figure(F.lit(""))).when(F.col("kind") == "paragraph", F.concat(F.lit("<p>"), t, F.lit("</p>")))
    )


def full_text(blocks: DataFrame) -> DataFrame:
    """One row per document: doc, html (a block a line, in reading order), and the numbers of headings, footnotes and figures.

    blocks: the result of classified(). What lies inside figures is left out.
    """
    rows = blocks.withColumn("__h", block_html())
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("__h").isNotNull(), F.struct("ord", "__h")))), lambda x: x["__h"])
    return rows.groupBy("doc").agg(F.array_join(lines, "\n").alias("html"), n("heading").alias("headings"), n("footnote").alias("footnotes"), n("figure", "equation").alias("figures"))


def resolved_footnotes(references: DataFrame, bodies: DataFrame) -> DataFrame:
    """Reference marks (doc, page, marker) with the footnote's text; of repeated footnotes the last counts."""
    last = keep_last(bodies.select("doc", "page", "marker", "ord", F.col("text").alias("body")), ["doc", "page", "marker"], ["ord"]).drop("ord")
    return references.join(merged(last), ["doc", "page", "marker"], "left")


def document_lines_furniture(pages: DataFrame, keys: Column, least: int = FURNITURE_PAGES) -> DataFrame:
    """Text keys that `least` or more pages hold, with the number of pages; a page is one row with the array of its keys.

    A page's keys are made distinct before they are rows, and counts have partial sums, so a line that every page holds
    costs one row a task.
    """
    keyed = pages.select(F.explode(F.array_distinct(keys)).alias("key")).where("key <> ''")
    return keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
