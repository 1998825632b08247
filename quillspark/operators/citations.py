"""References, the surface forms of their citations, and dictionary linking."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions.text import collapse, flatten_html
from quillspark.operators.joins import keep_first

# What counts as a surname before an initial, and at the start of an entry
SURNAME = r"([A-ZÀ-Þ][\w'’.\-]*(?:\s[A-ZÀ-Þ][\w'’\-]*)?)\s*,\s*[A-ZÀ-Þ]\."
LONE_SURNAME = r"^([A-ZÀ-Þ][\w'’\-]+)"
DATED = r"^(.*?)\((\d{4}[a-z]?)\)"
TAG = "<[^>]*>"


def reference_rows(df: DataFrame, doc: str, references: str) -> DataFrame:
    """One row per parsable reference paragraph: doc, ord, html, surnames, year (with its letter)."""
    paragraphs = F.regexp_extract_all(F.col(references), F.lit(r"(?s)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    rows = df.select(doc, F.posexplode(paragraphs).alias("ord", "raw"))
    text = flatten_html(F.col("raw"))
    u = "(?U)"
    rows = rows.withColumn("html", F.regexp_replace(collapse(F.col("raw")), r"\s+([,.;:])", "$1")).withColumn("__text", text)
    rows = rows.withColumn("__who", F.regexp_extract("__text", DATED, 1)).withColumn("year", F.regexp_extract("__text", DATED, 2)).where("year <> ''")
    many = F.regexp_extract_all(F.col("__who"), F.lit(u + SURNAME), F.lit(1))
    lone = F.regexp_extract(F.trim("__who"), u + LONE_SURNAME, 1)
    names = F.when(F.size(many) > 0, many).when(lone != "", F.array(lone)).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("surnames", names).where(F.size("surnames") > 0).select(doc, "ord", "html", "surnames", "year")


def who(surnames: Column) -> Column:
    one, two = F.element_at(surnames, 1), F.try_element_at(surnames, F.lit(2))
    return F.when(F.size(surnames) == 1, one).when(F.size(surnames) == 2, F.concat(one, F.lit(" & "), two)).otherwise(F.concat(one, F.lit(" et al.")))


def surfaces(references: DataFrame, doc: str) -> DataFrame:
    """(doc, surface, html): three forms for each reference, the first reference to claim a form keeps it."""
    name = F.replace(who(F.col("surnames")), F.lit("&"), F.lit("&amp;"))
    forms = F.array(F.concat(name, F.lit(" ("), "year", F.lit(")")), F.concat(name, F.lit(", "), "year"), F.concat(name, F.lit(" "), "year"))
    rows = references.select(doc, "ord", "html", F.posexplode(forms).alias("form", "surface"))
    return keep_first(rows, [doc, "surface"], ["ord", "form"]).select(doc, "surface", "html")


def link(text: str, forms: dict[str, str]) -> str:
    """Every form outside tags becomes a reference with a tooltip; the longest form wins, from left to right."""
    if not forms:
        return text
    known = re.compile("|".join(re.escape(f) for f in sorted(forms, key=len, reverse=True)))
    mark = lambda m: f'<span class="cite-ref" tabindex="0">{m[0]}<span class="cite-tooltip">{forms[m[0]]}</span></span>'
    return "".join(p if p.startswith("<") and p.endswith(">") else known.sub(mark, p) for p in re.split(f"({TAG})", text))


@F.pandas_udf(StringType())
def _link(text: pd.Series, forms: pd.Series) -> pd.Series:
    return pd.Series([t if t is None or f is None else link(t, {x["surface"]: x["html"] for x in f}) for t, f in zip(text, forms, strict=True)], dtype=object)


def link_citations(docs: DataFrame, forms: DataFrame, doc: str, text: str) -> DataFrame:
    """Documents with their citations linked by their own forms; a document without forms stays as it is."""
    lists = forms.groupBy(doc).agg(F.collect_list(F.struct("surface", "html")).alias("__forms"))
    return docs.join(lists, doc, "left").withColumn(text, _link(F.col(text), F.col("__forms"))).drop("__forms")


#: Phrases of a broadcast automaton; a larger dictionary costs a pass over the texts for each such block.
PHRASES = 100_000


def _greedy(found: list[tuple[int, int, str]]) -> dict[str, int]:
    """How often each phrase is taken from left to right, the longest first at each place, none inside another."""
    out: dict[str, int] = {}
    past = 0
    for start, neg, phrase in sorted((s, -n, p) for s, n, p in found):
        if start >= past:
            out[phrase] = out.get(phrase, 0) + 1
            past = start - neg
    return out


def _occurrences(words: list[str]):
    """A function that gives (start, length, phrase) of all occurrences of some phrases in a text."""
    made: dict = {}

    def find(text: str) -> list[tuple[int, int, str]]:
        if "it" not in made:
            import ahocorasick

            a = ahocorasick.Automaton()
            for w in words:
                a.add_word(w, w)
            a.make_automaton()
            made["it"] = a
        return [(end + 1 - len(w), len(w), w) for end, w in made["it"].iter(text)]

    return find


def dictionary_hits(docs: DataFrame, phrases: DataFrame, doc: str, text: str, phrase_id: str, phrase: str) -> DataFrame:
    """(doc, phrase id, n): how often each phrase is found in a text, for one dictionary for all documents.

    A text is read from left to right; at each place the longest phrase is taken, and what it covers is no part of another.
    Phrases may stand anywhere, inside words too. Ids that share a phrase have the same counts; empty phrases and null texts
    give nothing. `doc` tells rows apart. The phrases are broadcast as an automaton, in blocks of PHRASES.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[doc]
    known = phrases.select(F.col(phrase_id), F.col(phrase).alias("__p")).where("__p <> ''")
    distinct = known.select("__p").distinct()
    n = max(1, -(-distinct.count() // PHRASES))
    texts = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("text IS NOT NULL")
    parts = None
    for k in range(n):
        block = distinct.where(F.pmod(F.xxhash64("__p"), F.lit(n)) == k) if n > 1 else distinct
        find = spark.sparkContext.broadcast(block.toArrow().column("__p").to_pylist())

        def scan(batches, find=find):
            look = _occurrences(find.value)
            for pdf in batches:
                rows = []
                for d, t in zip(pdf["doc"], pdf["text"], strict=True):
                    hits = look(t) if find.value else []
                    rows += [(d, w, None, c) for w, c in _greedy(hits).items()] if n == 1 else [(d, w, s, 0) for s, _, w in hits]
                yield pd.DataFrame(rows, columns=["doc", "__p", "at", "n"]).astype({"at": "Int64", "n": "int64"})

        found = texts.mapInPandas(scan, f"doc {kind}, `__p` string, at long, n long")
        parts = found if parts is None else parts.unionByName(found)
    if n > 1:

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            taken = _greedy([(int(s), len(w), w) for s, w in zip(pdf["at"], pdf["__p"], strict=True)])
            return pd.DataFrame([(pdf["doc"].iloc[0], w, c) for w, c in taken.items()], columns=["doc", "__p", "n"])

        parts = parts.groupBy("doc").applyInPandas(merge, f"doc {kind}, `__p` string, n long")
    return parts.join(known, "__p").select(F.col("doc").alias(doc), phrase_id, "n")
