"""Navigation, page lists and the funnel of sheet rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.dates import parse_de
from quillspark.functions.ids import doi_or_url, preprint_doi, prereview_url, strip, text_or_empty
from quillspark.functions.text import fallback, folder_title
from quillspark.operators.joins import keep_first, keep_last

# Words in a status that end a review, and the links of the materials list in order
TERMINAL = r"(?i)\b(published|accepted|withdrawn|declined|rejected|desk reject)\b"
MATERIALS = [("Peer Review Report", "peerReviewUrl"), ("Reproducibility Certificate", "reproCertUrl"), ("Data", "dataUrl"), ("Materials", "materialsUrl")]


def public_rows(df: DataFrame, status: str, key: str) -> DataFrame:
    """Rows with a status that does not end a review and a numeric id."""
    s, k = strip(text_or_empty(F.col(status))), strip(text_or_empty(F.col(key)))
    return df.where((s != "") & k.rlike("^[0-9]+$") & ~s.rlike(TERMINAL))


def under_review(sheet: DataFrame, lookup: DataFrame) -> DataFrame:
    """Sheet rows under review with what the registries know; by submission date descending, as text.

    lookup: doi, title, authors, abstract, one row a DOI. Rows are filtered before any lookup.
    """
    empty = F.lit(None).cast("array<struct<name:string,affiliation:string,orcid:string>>")
    c = lambda n: strip(text_or_empty(F.col(f"`{n}`")))
    rows = public_rows(sheet, "Stage website", "ID").withColumn("doi", preprint_doi(c("Preprint")))
    rows = rows.join(lookup.select("doi", F.col("title").alias("__t"), F.col("authors").alias("__a"), F.col("abstract").alias("__x")), "doi", "left")
    lone = F.array(F.struct(c("First Author").alias("name"), F.lit("").alias("affiliation"), F.lit("").alias("orcid")))
    authors = F.when(F.size(F.coalesce("__a", F.array().cast("array<struct<name:string,affiliation:string,orcid:string>>"))) > 0, F.col("__a")).when(c("First Author") != "", lone).otherwise(F.coalesce(empty, F.array().cast("array<struct<name:string,affiliation:string,orcid:string>>")))
    out = rows.select(
        c("ID").alias("id"), fallback(F.col("__t"), folder_title(F.col("`GDrive Folder`")), last="Untitled submission").alias("title"), authors.alias("authors"), c("Preprint").alias("preprintUrl"),
        F.when(F.col("doi") != "", prereview_url(F.col("doi"))).otherwise("").alias("prereviewUrl"), c("PubPeer Comments").alias("pubpeerUrl"), text_or_empty(F.col("__x")).alias("abstractHtml"),
        c("Lay Summary").alias("laySummary"), c("Stage website").alias("status"), c("Handling Editor").alias("handlingEditor"), parse_de(F.col("`Submission Date`")).alias("submissionDate"),
    )
    return out.orderBy(F.desc("submissionDate"), "id")


def published_extras(sheet: DataFrame, order: str) -> DataFrame:
    """Links by DOI; rows without a DOI or without any link are dropped, the last row of a DOI counts."""
    from quillspark.functions.ids import bare_doi

    links = [doi_or_url(F.col(f"`{n}`")).alias(k) for n, k in MATERIALS]
    rows = sheet.select(bare_doi(F.col("`Published DOI`")).alias("doi"), *links, strip(text_or_empty(F.col("`Lay Summary`"))).alias("laySummary"), order)
    some = F.lit(False)
    for k in [*(k for _, k in MATERIALS), "laySummary"]:
        some = some | (F.col(k) != "")
    return keep_last(rows.where((F.col("doi") != "") & some), ["doi"], [order]).drop(order)


def materials(fields: list[tuple[str, str]] = MATERIALS) -> Column:
    """Non-empty links of fixed columns as an ordered list of label and url."""
    return F.filter(F.array(*[F.struct(F.lit(n).alias("label"), text_or_empty(F.col(k)).alias("url")) for n, k in fields]), lambda m: m["url"] != "")


def nav_rows(items: DataFrame, pages: DataFrame, about: DataFrame, overrides: DataFrame, aliases: DataFrame) -> DataFrame:
    """(grp, ord, label, path): children of the first group, then other items that lead somewhere, each path once.

    about: path, ord. aliases: path, url of routes that are no pages. An item leads somewhere if its path is a page or
    an alias; a child's label is its override, else that of the item, else the child goes.
    """
    known = pages.select(F.col("slug").alias("path")).unionByName(aliases.select("path")).distinct()
    labels = keep_first(items.select("path", "ord", "label"), ["path"], ["ord"]).select("path", "label")
    from quillspark.operators.joins import label_override

    children = label_override(about.join(known, "path", "left_semi"), overrides, labels).select(F.lit(0).alias("grp"), "ord", "label", "path")
    rest = keep_first(items.select("path", "ord", "label"), ["path"], ["ord"]).join(about, "path", "left_anti").join(known, "path", "left_semi")
    return children.unionByName(rest.select(F.lit(1).alias("grp"), "ord", "label", "path"))


def page_list(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    """Fixed groups of pages (anchor, title, ord) one after another, each in its own order."""
    out = None
    for rank, df in parts:
        rows = df.select(F.lit(rank).alias("grp"), "ord", "anchor", "title")
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("grp", "ord")


def with_presence(listed: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Listed pages with a flag whether their file exists, instead of dangling entries."""
    return listed.join(files.select(key).distinct().withColumn("present", F.lit(True)), key, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def visible_blocks(blocks: str = "sidebarBlocks") -> Column:
    return F.filter(blocks, lambda b: ~F.coalesce(b["titleHidden"], F.lit(False)))


def pair_case(a: Column, b: Column, both: str, first: str, second: str, none: str) -> Column:
    """Four-way choice on the presence of two optional links."""
    a, b = text_or_empty(a) != "", text_or_empty(b) != ""
    return F.when(a & b, both).when(a, first).when(b, second).otherwise(none)
