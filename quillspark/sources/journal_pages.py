"""Records of a journal's pages: home page, pages, team, issues, articles, announcements, guides.

Each is a projection for pages.scraped(). Those that keep HTML belong to a Site, which resolves and routes links, gives
images their local names and demotes landmark elements.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlparse

from quillspark.sources.pages import ISSN, Node, inner, outer, select, tree

# Where the platform's pages keep each field, and the paths that stand for lists and for the home page
ARTICLE_TEXT = {"title": "h1.page_title|h1", "subtitle": "h2.subtitle", "datePublished": ".published .value", "citation": ".csl-entry"}
ISSUE_LISTS, HOMES = ("issue/archive", "issues", "issue/current"), ("index", "home", "")
NOT_MIRRORED = ("issues", "issue/current", "issue/archive", "search", "login", "user/register", "index", "home", "announcement", "about/contact")
NOT_MIRRORED_BELOW, ALWAYS_MIRRORED = ("issue/", "article/", "user/"), ("legal-disclosure",)

BLOCKS = "ARRAY<STRUCT<id: STRING, title: STRING, titleHidden: BOOLEAN, html: STRING>>"
JOURNAL = f"name STRING, description STRING, keywords STRING, issn STRING, ojsUrl STRING, submitUrl STRING, submissionsInfoUrl STRING, logo STRING, favicon STRING, homepageHtml STRING, sidebarBlocks {BLOCKS}, footerHtml STRING, nav ARRAY<STRUCT<label: STRING, path: STRING>>"
PAGE = "title STRING, html STRING, sourceUrl STRING"
ISSUES = "issues ARRAY<STRUCT<id: STRING, title: STRING, series: STRING, descriptionHtml: STRING, cover: STRING, ojsUrl: STRING>>"
TOC = "datePublished STRING, descriptionHtml STRING, sections ARRAY<STRUCT<title: STRING, articles: ARRAY<STRING>>>"
ARTICLE = (
    "title STRING, subtitle STRING, datePublished STRING, citation STRING, authors ARRAY<STRUCT<name: STRING, affiliation: STRING, orcid: STRING>>, doi STRING, doiUrl STRING, keywords ARRAY<STRING>, "
    "abstractHtml STRING, referencesHtml STRING, licenseHtml STRING, bibtexUrl STRING, risUrl STRING, submissionId STRING, section STRING, categories ARRAY<STRING>, "
    "galleys ARRAY<STRUCT<label: STRING, isPdf: BOOLEAN, viewUrl: STRING, downloadUrl: STRING, localPdf: STRING>>, ojsUrl STRING"
)
TEAM = "sections ARRAY<STRUCT<title: STRING, members: ARRAY<STRING>, hasPhotos: BOOLEAN, noteHtml: STRING>>"
ANNOUNCEMENTS = "items ARRAY<STRUCT<id: STRING, title: STRING>>"
ANNOUNCEMENT = "title STRING, date STRING, html STRING, ojsUrl STRING"


class Missing(ValueError):
    """A page lacks its container."""


def _one(node: Node, path: str) -> Node | None:
    return next(iter(select(node, path)), None)


def _text(node: Node, path: str) -> str:
    found = _one(node, path)
    return found.text() if found is not None else ""


def _without(node: Node, gone) -> Node:
    """A node without the descendants that `gone` says yes to."""
    return Node(node.tag, node.attrs, [_without(c, gone) if isinstance(c, Node) else c for c in node.children if not (isinstance(c, Node) and gone(c))])


def _without_heading(node: Node) -> Node:
    label = node.find("h2")
    return _without(node, lambda n: n is label)


def _attr(node: Node | None, name: str) -> str:
    return (node.attrs.get(name) or "").strip() if node is not None else ""


@dataclass
class Site:
    """A journal at `url`; `bases` are other addresses of it, `known` the paths of mirrored pages. `images` maps addresses
    of images that could not be had to what stands in their place; the others have a local name."""

    url: str
    bases: tuple[str, ...] = ()
    known: frozenset = frozenset()
    place: str = "__BASE__"
    images: dict = field(default_factory=dict)

    def path(self, url: str) -> str | None:
        """The path inside the journal, None outside."""
        for base in (self.url, *self.bases):
            if url == base or url.startswith(base + "/"):
                return url[len(base) :].partition("#")[0].partition("?")[0].strip("/")
        return None

    def key(self, url: str, kind: str, exact: bool = True) -> str:
        """What follows `kind` in a path of the journal: one segment, the last one where `exact`; '' for another path."""
        parts = (self.path(url) or "").split("/")
        ok = parts[:2] == kind.split("/") and len(parts) > 2 and (len(parts) == 3 or not exact)
        return parts[2] if ok else ""

    def route(self, url: str) -> str:
        path = self.path(url)
        if path is None:
            return url
        for kind, to, exact in (("article/view", "articles", False), ("issue/view", "issues", True), ("announcement/view", "announcements", True)):
            if key := self.key(url, kind, exact):
                return f"{self.place}{to}/{key}/"
        if path in HOMES:
            return self.place
        local = "issues" if path in ISSUE_LISTS else "announcements" if path == "announcement" else path if path in self.known else None
        return url if local is None else f"{self.place}{local}/"

    def image(self, src: str, page: str) -> str:
        if not src or src.startswith("data:"):
            return src
        whole = urljoin(page, src)
        name = re.sub("[^A-Za-z0-9._-]", "_", urlparse(whole).path.rpartition("/")[2]) or "img"
        return self.images.get(whole, f"{self.place}assets/img/{hashlib.sha1(whole.encode()).hexdigest()[:8]}-{name}")

    def clean(self, node: Node | None, page: str) -> str:
        """Inner HTML with landmarks as div, links resolved and routed, images localised, and no srcset; '' for no node."""
        return clean_node(node, page, self.route, self.image) if node is not None else ""

    def page_record(self, text: str, path: str) -> dict:
        """Title and cleaned HTML of a page, without its crumbs and its h1; a page without its container is an error."""
        main = _one(tree(text), ".pkp_structure_main .page")
        if main is None:
            raise Missing("no page")
        main = _without(main, lambda n: n.tag == "nav" and "cmp_breadcrumbs" in n.attrs.get("class", "").split())
        h1 = main.find("h1")
        rest = _without(main, lambda n: n is h1)
        return {"title": h1.text() if h1 is not None else "", "html": self.clean(rest, f"{self.url}/{path}"), "sourceUrl": f"{self.url}/{path}"}

    def journal_record(self, text: str) -> dict:
        """The home page: names, identifiers, logo, navigation, sidebar blocks, and the HTML of home page and footer."""
        doc, page = tree(text), self.url + "/index"
        meta = lambda key, name: next((_attr(m, "content") for m in doc.find_all("meta") if m.attrs.get(key) == name), "")
        nav = [{"label": a.text(), "path": self.path(_attr(a, "href"))} for top in doc.find_all() if top.attrs.get("id") == "navigationPrimary" for a in top.find_all("a")]
        nav = [n for n in nav if n["path"] is not None and n["label"]]
        site = Site(self.url, self.bases, self.known | frozenset(mirrored_paths([n["path"] for n in nav])), self.place, self.images)
        icon = next((n for n in doc.find_all("link") if "icon" in n.attrs.get("rel", "").split() and n.attrs.get("href")), None)
        footer, extra = _one(doc, ".pkp_footer_content"), _one(doc, ".additional_content")
        issn = re.search(ISSN, "".join(footer.texts())) if footer is not None else None
        blocks = []
        for block in select(doc, ".pkp_structure_sidebar .pkp_block.block_custom"):
            title, content = block.find("h2"), _one(block, ".content")
            if content is not None:
                hidden = title is not None and "pkp_screen_reader" in title.attrs.get("class", "").split()
                blocks.append({"id": block.attrs.get("id", ""), "title": title.text() if title is not None else "", "titleHidden": hidden, "html": site.clean(content, page)})
        return {
            "name": meta("property", "og:title") or "Replication Research", "description": meta("name", "description"), "keywords": meta("name", "keywords"), "issn": issn[1] if issn else "",
            "ojsUrl": self.url, "submitUrl": self.url + "/submission/wizard", "submissionsInfoUrl": self.url + "/about/submissions", "logo": self.image(_attr(_one(doc, ".pkp_site_name img"), "src"), page),
            "favicon": self.image(_attr(icon, "href"), page), "homepageHtml": site.clean(extra, page), "sidebarBlocks": blocks, "footerHtml": site.clean(footer, page), "nav": nav,
        }

    def issue_summaries(self, text: str) -> dict:
        """Issues of an archive page in order; summaries whose link leads to no issue of the journal are left out."""
        out, page = [], self.url + "/issue/archive"
        for s in select(tree(text), ".obj_issue_summary"):
            link = _one(s, "a.title")
            key = self.key(_attr(link, "href"), "issue/view")
            if key:
                out.append({
                    "id": key, "title": link.text(), "series": _text(s, ".series"), "descriptionHtml": self.clean(_one(s, ".description"), page), "cover": self.image(_attr(_one(s, ".cover img"), "src"), page),
                    "ojsUrl": f"{self.url}/issue/view/{key}",
                })
        return {"issues": out}

    def issue_toc(self, text: str, issue: str = "") -> dict:
        """Date, description and sections of an issue; sections without articles are dropped, no contents is an error."""
        toc = _one(tree(text), ".obj_issue_toc")
        if toc is None:
            raise Missing("no table of contents")
        sections = []
        for s in select(toc, ".sections .section"):
            links = (_attr(a, "href") for item in select(s, ".obj_article_summary") for a in select(item, ".title a")[:1])
            keys = [k for k in (self.key(h, "article/view", exact=False) for h in links) if k]
            if keys:
                sections.append({"title": _text(s, "h2"), "articles": keys})
        return {"datePublished": _text(toc, ".heading .published .value"), "descriptionHtml": self.clean(_one(toc, ".heading .description"), f"{self.url}/issue/view/{issue}"), "sections": sections}

    def with_toc(self, issue: dict, text: str | None) -> dict:
        """An issue with its contents; the summary's description wins, a broken page leaves the issue without sections."""
        try:
            toc = self.issue_toc(text or "", issue["id"])
        except Missing:
            return {**issue, "datePublished": "", "sections": []}
        return {**issue, **toc, "descriptionHtml": issue["descriptionHtml"] or toc["descriptionHtml"]}

    def article_record(self, text: str, path: str = "") -> dict:
        """An article's fields; no article on the page is an error, any other missing field is empty."""
        d = _one(tree(text), ".obj_article_details|.page_article article")
        if d is None:
            raise Missing("no article")
        page = f"{self.url}/article/view/{path}"
        out = {k: _text(d, at) for k, at in ARTICLE_TEXT.items()}
        out["authors"] = [{"name": _text(li, ".name"), "affiliation": _text(li, ".affiliation"), "orcid": _attr(_one(li, ".orcid a"), "href")} for li in select(d, ".authors ul.authors li")]
        out["doiUrl"] = _attr(_one(d, ".doi .value a"), "href")
        out["doi"] = re.sub("^https?://doi[.]org/", "", out["doiUrl"])
        out["keywords"] = [k for k in map(str.strip, _text(d, ".keywords .value").split(",")) if k]
        for name, at in (("abstractHtml", ".abstract"), ("licenseHtml", ".copyright")):
            found = _one(d, at)
            out[name] = self.clean(_without_heading(found), page) if found is not None else ""
        out["referencesHtml"] = self.clean(_one(d, ".references .value"), page)
        out["submissionId"] = ""
        for kind in ("bibtex", "ris"):
            href = next((_attr(a, "href") for a in d.find_all("a") if f"citationstylelanguage/download/{kind}" in _attr(a, "href")), "")
            out[kind + "Url"] = href
            number = re.search(r"submissionId=(\d+)", href)
            out["submissionId"] = number[1] if number else out["submissionId"]
        subs = [s for s in select(d, ".issue .sub_item") if "section" in _text(s, "h2").lower()]
        out["section"] = _text(subs[-1], ".value") if subs else ""
        out["categories"] = [a.text() for a in select(d, ".issue .categories a")]
        out["galleys"], out["ojsUrl"] = [], page
        for a in select(d, ".galleys a.obj_galley_link"):
            href = urljoin(page, _attr(a, "href"))
            parts = (self.path(href) or "").split("/")
            if parts[:2] == ["article", "view"] and len(parts) == 4:
                pdf = "pdf" in a.attrs.get("class", "").split() or a.text().upper() == "PDF"
                out["galleys"].append({"label": a.text(), "isPdf": pdf, "viewUrl": href, "downloadUrl": f"{self.url}/article/download/{parts[2]}/{parts[3]}", "localPdf": f"{parts[2]}-{parts[3]}.pdf" if pdf else ""})
        return out

    def announcement_list(self, text: str) -> dict:
        """Ids (numbers) and titles of the announcements on their list page, in order."""
        links = (s.find("a") for s in select(tree(text), ".obj_announcement_summary"))
        found = [(self.key(_attr(a, "href"), "announcement/view"), a) for a in links if a is not None]
        return {"items": [{"id": k, "title": a.text()} for k, a in found if k.isdigit()]}

    def announcement_record(self, text: str, key: str = "", title: str = "") -> dict:
        """Title (that of the list without one), date and body; no container is an error, an empty body is kept."""
        d = _one(tree(text), ".obj_announcement_full")
        if d is None:
            raise Missing("no announcement")
        page = f"{self.url}/announcement/view/{key}"
        return {"title": _text(d, "h1") or title, "date": _text(d, ".date"), "html": self.clean(_one(d, ".description"), page), "ojsUrl": page}


def mirrored_paths(paths: list[str]) -> list[str]:
    """Paths of the navigation that are pages to mirror, each once and in order, then those that always are."""
    out = [p for p in paths if p not in NOT_MIRRORED and not p.startswith(NOT_MIRRORED_BELOW)]
    return list(dict.fromkeys([*out, *ALWAYS_MIRRORED]))


def team_sections(page: str) -> dict:
    """Sections of a team page: a paragraph that is all strong opens one with photos, one that begins with strong text opens
    one without and is, less the heading and a line break after it, its note. Other paragraphs are notes, as HTML; items
    of lists are members, as text. What precedes the first section, and sections with neither, are dropped."""
    out: list[dict] = []
    for node in tree(page).children:
        if not isinstance(node, Node):
            continue
        if node.tag == "p":
            strong = node.find("strong")
            first = next((c for c in node.children if not isinstance(c, str) or c.strip()), None)
            if strong is not None and strong.text() == node.text():
                out.append({"title": strong.text(), "members": [], "hasPhotos": True, "noteHtml": ""})
            elif strong is not None and first is strong:
                rest = _without(node, lambda n, strong=strong: n is strong)
                first = next((c for c in rest.children if not isinstance(c, str) or c.strip()), None)
                if isinstance(first, Node) and first.tag == "br":
                    rest = _without(rest, lambda n, first=first: n is first)
                out.append({"title": strong.text(), "members": [], "hasPhotos": False, "noteHtml": outer(rest)})
            elif out:
                out[-1]["noteHtml"] += outer(node)
        elif node.tag == "ul" and out:
            out[-1]["members"] += [li.text() for li in node.children if isinstance(li, Node) and li.tag == "li"]
    return {"sections": [s for s in out if s["members"] or s["noteHtml"]]}


def guide_rows(page: str) -> list[tuple[int, str, str]]:
    """(ord, heading, HTML up to the next heading) for each top-level h2; what precedes the first belongs to none."""
    out: list[list] = []
    for c in tree(page).children:
        if isinstance(c, Node) and c.tag == "h2":
            out.append([len(out), c.text(), []])
        elif out:
            out[-1][2].append(c)
    return [(i, t, inner(Node("", {}, rest))) for i, t, rest in out]


def clean_node(node: Node, url: str, route, image) -> str:
    """Inner HTML with landmarks as div, links resolved and routed, images localised, and no srcset."""
    for n in node.find_all():
        if n.tag in ("main", "header", "footer"):
            n.tag = "div"
        if n.tag == "a" and "href" in n.attrs:
            n.attrs["href"] = route(urljoin(url, n.attrs["href"]))
        if n.tag == "img":
            n.attrs.pop("srcset", None)
            if n.attrs.get("src"):
                n.attrs["src"] = image(n.attrs["src"], url)
    return inner(node)


def clean_fragment(page: str, url: str, route, image) -> str:
    return clean_node(tree(page), url, route, image)


def strip_panel(page: str, gone: str = "pdf", stays: str = "html") -> str:
    """Without the tab and panel of one view; if there was a panel, the other view becomes the active one."""
    root = tree(page)
    ids = {f"tab-{gone}", f"panel-{gone}"}

    def cut(node: Node) -> bool:
        found = any(isinstance(c, Node) and c.attrs.get("id") == f"panel-{gone}" for c in node.children)
        node.children = [c for c in node.children if not (isinstance(c, Node) and c.attrs.get("id") in ids)]
        return any([found, *(cut(c) for c in node.children if isinstance(c, Node))])

    if cut(root):
        for n in root.find_all():
            if n.attrs.get("id") in (f"tab-{stays}", f"panel-{stays}"):
                n.attrs["class"] = " ".join(dict.fromkeys([*n.attrs.get("class", "").split(), "is-active"]))
                n.attrs.pop("hidden", None)
                if "aria-selected" in n.attrs:
                    n.attrs["aria-selected"] = "true"
    return inner(root)


def inline_images(page: str, uris: dict[str, str]) -> str:
    """Root-relative images as data URIs; images without one, and those of other hosts, stay."""
    return re.sub(r'src="(/(?!/)[^"]*)"', lambda m: f'src="{uris.get(m[1], m[1])}"', page)
