"""Web pages into rows: a small HTML tree from the standard library inside Arrow functions, and projections of it."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# How the identifier of a serial is written, and elements without an end tag
ISSN = r"ISSN:\s*([\d-]+X?)"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)

    def find_all(self, *tags: str, cls: str = ""):
        left = self.children[::-1]
        while left:
            c = left.pop()
            if isinstance(c, Node):
                if (not tags or c.tag in tags) and (not cls or cls in (has := c.attrs.get("class", "")) and cls in has.split()):
                    yield c
                left += c.children[::-1]

    def find(self, *tags: str, cls: str = "") -> Node | None:
        return next(self.find_all(*tags, cls=cls), None)

    def texts(self):
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif c.tag not in ("script", "style"):
                yield from c.texts()

    def text(self) -> str:
        t = re.sub(r"\s+", " ", " ".join(s for s in (x.strip() for x in self.texts()) if s))
        return re.sub(r"\s+([,.;:])", r"\1", t).strip()


def select(node: Node, path: str) -> list[Node]:
    """Nodes at a path of `tag.class` steps (either part may be left out); of alternatives split by | the first found."""
    for way in path.split("|"):
        found = [node]
        for step in way.split():
            tag, *classes = step.split(".")
            found = [n for f in found for n in f.find_all(*([tag] if tag else []), cls=(classes or [""])[0]) if len(classes) < 2 or set(classes) <= set(n.attrs.get("class", "").split())]
        if found:
            return list({id(n): n for n in found}.values())
    return []


def outer(node: Node) -> str:
    """HTML of a node itself."""
    attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in node.attrs.items())
    return f"<{node.tag}{attrs}>" + ("" if node.tag in VOID else f"{_held(node)}</{node.tag}>")


def _held(node: Node) -> str:
    return "".join(html.escape(c, quote=False) if isinstance(c, str) else outer(c) for c in node.children)


def inner(node: Node | None) -> str:
    """HTML of what a node holds, without white space at its ends."""
    return _held(node).strip() if node is not None else ""


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(text: str | None) -> Node:
    t = _Tree()
    t.feed(text or "")
    t.close()
    return t.root


def page_record(text: str | None) -> dict:
    """title, description, text, headings and links of a page; empty values where the page has none."""
    root = tree(text)
    title, h1 = root.find("title"), root.find("h1")
    meta = {n.attrs.get("name", "").lower(): n.attrs.get("content", "") for n in root.find_all("meta")}
    issn = re.search(ISSN, root.text())
    return {
        "title": (h1 or title).text() if h1 or title else "", "description": meta.get("description", ""), "issn": issn[1] if issn else "",
        "text": root.text(), "headings": [h.text() for h in root.find_all("h1", "h2", "h3")], "links": [a.attrs["href"] for a in root.find_all("a") if a.attrs.get("href")],
    }


PAGE = "title STRING, description STRING, issn STRING, text STRING, headings ARRAY<STRING>, links ARRAY<STRING>"


def scraped(pages: DataFrame, key: str, page: str, project=page_record, fields: str = PAGE, also: tuple[str, ...] = ()) -> DataFrame:
    """key, the projection's fields, and `error`: a page that cannot be read gives a row with the error, not a failure.

    project takes the page and the values of the columns `also`, such as its address.
    """
    kinds = to_arrow_schema(StructType.fromDDL(f"{fields}, error STRING"))

    def run(batches):
        for batch in batches:
            rows = []
            for h, *more in zip(*(batch.column(c).to_pylist() for c in (page, *also)), strict=True):
                try:
                    rows.append({**project(h, *more), "error": None})
                except Exception as e:  # noqa: BLE001  isolation of one item
                    rows.append({"error": f"{type(e).__name__}: {e}"})
            made = [pa.array([r.get(f.name) for r in rows], f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(key), *made], names=[key, *kinds.names])

    return pages.select(*dict.fromkeys([key, page, *also])).mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, {fields}, error STRING")


def team_rows(text: str | None) -> list[tuple]:
    """(kind, opens, title, text) of each paragraph and list item at the top of a team page, for section_rows()."""
    out = []
    for node in tree(text).children:
        if not isinstance(node, Node):
            continue
        if node.tag == "p":
            strong = node.find("strong")
            first = next((c for c in node.children if not isinstance(c, str) or c.strip()), None)
            if strong is not None and strong.text() == node.text():
                out.append(("text", True, strong.text(), ""))
            elif strong is not None and first is strong:
                rest = Node("p", {}, [c for c in node.children if c is not strong])
                out += [("text", True, strong.text(), ""), ("text", False, None, rest.text())]
            else:
                out.append(("text", False, None, node.text()))
        elif node.tag == "ul":
            out += [("list", False, None, li.text()) for li in node.children if isinstance(li, Node) and li.tag == "li"]
    return out


def discovered(links: DataFrame, order: str, path: str, excluded: list[str], prefixes: list[str], extras: list[str]) -> DataFrame:
    """Distinct paths in the order of their first link, without exclusions, then mandatory extras that are missing."""
    keep = ~F.col(path).isin(*excluded) if excluded else F.lit(True)
    for p in prefixes:
        keep = keep & ~F.col(path).startswith(p)
    found = links.where(keep & (F.col(path) != "")).groupBy(path).agg(F.min(order).alias("ord"))
    spark = links.sparkSession
    more = spark.createDataFrame([(e, i) for i, e in enumerate(extras)], f"{path} string, ord long").join(found, path, "left_anti")
    return found.select(path, F.lit(0).alias("rank"), "ord").unionByName(more.select(path, F.lit(1).alias("rank"), "ord")).orderBy("rank", "ord")
