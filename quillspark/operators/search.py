"""The article index and its faceted search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.dates import year_of
from quillspark.functions.ids import text_or_empty


def article_index(articles: DataFrame) -> DataFrame:
    """Compact search records. Texts are never NULL; year, views and downloads may be."""
    c = F.col
    empty = F.array().cast("array<string>")
    return articles.select(
        text_or_empty(c("title")).alias("title"), text_or_empty(c("subtitle")).alias("subtitle"), F.concat(F.lit("articles/"), c("urlPath"), F.lit("/")).alias("url"),
        text_or_empty(c("section")).alias("section"), F.coalesce(c("categories"), empty).alias("categories"), F.coalesce(F.transform("authors", lambda a: a["name"]), empty).alias("authors"),
        year_of(c("datePublished")).alias("year"), text_or_empty(c("datePublished")).alias("date"), "views", "downloads", "ord",
    )


def search_text(title: Column, subtitle: Column, authors: Column) -> Column:
    """What the needle is looked for in; an empty subtitle leaves two blanks."""
    return F.lower(F.concat(text_or_empty(title), F.lit(" "), text_or_empty(subtitle), F.lit(" "), F.array_join(authors, " ")))


def facet_search(index: DataFrame, q: str = "", sections: list[str] | None = None, categories: list[str] | None = None, years: tuple[int, int] | None = None, n_sections: int | None = None, n_categories: int | None = None) -> DataFrame:
    """Records that pass all facets, by date descending and then in index order, with their rank.

    A facet with as many choices as there are options (n_*) is off, and so is one that is None. Records without
    categories or year always pass those facets; a blank section fails a section facet. Only facets that are on are in
    the plan, so a scan sees just their predicates.
    """
    needle = q.strip().lower()
    out = index
    if needle:
        out = out.where(search_text(F.col("title"), F.col("subtitle"), F.col("authors")).contains(needle))
    if sections is not None and len(sections) != n_sections:
        out = out.where(F.col("section").isin(*sections) if sections else F.lit(False))
    if categories is not None and len(categories) != n_categories:
        some = F.arrays_overlap("categories", F.array(*map(F.lit, categories)).cast("array<string>")) if categories else F.lit(False)
        out = out.where((F.size("categories") == 0) | some)
    if years is not None:
        out = out.where(F.col("year").isNull() | F.col("year").between(min(years), max(years)))
    return out.orderBy(F.desc("date"), F.asc("ord"))


def facet_options(index: DataFrame) -> DataFrame:
    """Sorted distinct sections and categories, and the span of years (the current year without any)."""
    now = F.year(F.current_date())
    year = F.when(F.col("year") != 0, F.col("year"))
    sections = F.sort_array(F.collect_set(F.nullif(F.col("section"), F.lit(""))))
    return index.agg(sections.alias("sections"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("categories")))).alias("categories"), F.coalesce(F.min(year), now).alias("yearMin"), F.coalesce(F.max(year), now).alias("yearMax"))


def facet_summary(checked: Column, total: Column) -> Column:
    return F.when(checked == total, "(all)").otherwise(F.concat(F.lit("("), checked, F.lit("/"), total, F.lit(")")))


def count_label(n: Column, one: str = "article", many: str = "articles") -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))
