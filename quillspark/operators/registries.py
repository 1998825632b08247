"""Records of two DOI registries in one shape: doi, title, authors, abstract. Rows with neither title nor author go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.ids import strip, text_or_empty
from quillspark.functions.text import first_where, jats_to_html, person_name, unescape_fixpoint
from quillspark.operators.joins import cascade


def _record(df: DataFrame, title: Column, authors: Column, abstract: Column) -> DataFrame:
    known = F.filter(authors, lambda a: a["name"] != "").alias("authors")
    rows = df.select("doi", unescape_fixpoint(strip(text_or_empty(title))).alias("title"), known, jats_to_html(abstract).alias("abstract"))
    return rows.where((F.col("title") != "") | (F.size("authors") > 0))


def _author(name: Column, orcid: Column) -> Column:
    return F.struct(text_or_empty(name).alias("name"), F.lit("").alias("affiliation"), text_or_empty(orcid).alias("orcid"))


_NONE = "array<struct<name:string,affiliation:string,orcid:string>>"


def first_registry(df: DataFrame) -> DataFrame:
    """doi, title ARRAY<STRING>, author ARRAY<STRUCT<given, family, ORCID>>, abstract."""
    people = F.coalesce(F.transform("author", lambda a: _author(person_name(a["given"], a["family"]), a["ORCID"])), F.array().cast(_NONE))
    return _record(df, F.try_element_at("title", F.lit(1)), people, F.col("abstract"))


def second_registry(df: DataFrame) -> DataFrame:
    """doi, titles, creators (with a literal name and identifiers), descriptions (the first abstract counts)."""

    def person(c):
        orcid = first_where(c["nameIdentifiers"], lambda i: F.upper(i["nameIdentifierScheme"]) == "ORCID")["nameIdentifier"]
        return _author(person_name(c["givenName"], c["familyName"], c["name"]), orcid)

    people = F.coalesce(F.transform("creators", person), F.array().cast(_NONE))
    abstract = first_where(F.col("descriptions"), lambda d: F.lower(strip(d["descriptionType"])) == "abstract")["description"]
    return _record(df, F.try_element_at("titles", F.lit(1))["title"], people, abstract)


def lookup(keys: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Metadata of each DOI: the first registry's record, the second's for DOIs it lacks, NULL for those of neither."""
    return cascade(keys.select("doi").distinct(), "doi", first, second)
