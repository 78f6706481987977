"""Web pages: clean text, main content, links, images, tables, code, metadata and Markdown from HTML.

One pass of the standard library's parser over each page; everything else is read off its events.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import col
from millrace.functions.text import domain
from millrace.operators.textmap import flat_map_text

# Tags and class words of what is not content.
DROPPED = frozenset("script style nav header footer aside noscript button svg template".split())
UNSEEN = frozenset("script style template".split())
JUNK = re.compile(r"(?i)\b(ads?|advert\w*|banner|cookie|popup|sidebar|share|social|promo|breadcrumb|newsletter)\b")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("p div section article main li ul ol h1 h2 h3 h4 h5 h6 table tr pre blockquote figure".split())


@dataclass
class Page:
    text: str = ""
    links: list[tuple[str, str]] = field(default_factory=list)
    images: list[tuple[str, str]] = field(default_factory=list)
    tables: list[list[list[str]]] = field(default_factory=list)
    code: list[tuple[str, str]] = field(default_factory=list)
    markdown: str = ""


class _Reader(HTMLParser):
    def __init__(self, url: str, whole: bool = False):
        super().__init__(convert_charrefs=True)
        self.dropped = UNSEEN if whole else DROPPED
        self.whole = whole
        self.url, self.page = url, Page()
        self.stack: list[str] = []
        self.hidden: int | None = None
        self.out: list[str] = []
        self.md: list[str] = []
        self.link: list | None = None
        self.cells: list[list[str]] | None = None
        self.pre: list | None = None
        self.lists: list[list] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag not in VOID:
            self.stack.append(tag)
        if self.hidden is not None:
            return
        junk = not self.whole and JUNK.search(f"{a.get('class', '')} {a.get('id', '')}".replace("-", " ").replace("_", " "))
        if tag in self.dropped or (junk and tag in ("div", "section", "ul", "span", "p")):
            if tag not in VOID:
                self.hidden = len(self.stack) - 1
            return
        if tag in BLOCKS or tag == "br":
            self.out.append("\n")
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.md.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "blockquote", "table"):
            self.md.append("\n\n" + ("> " if tag == "blockquote" else ""))
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            if self.lists:
                self.lists[-1][1] += 1
            mark = f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] == "ol" else "- "
            self.md.append("\n" + "  " * (len(self.lists) - 1) + mark)
        elif tag in ("strong", "b"):
            self.md.append("**")
        elif tag in ("em", "i"):
            self.md.append("*")
        elif tag == "br":
            self.md.append("\n")
        elif tag == "hr":
            self.md.append("\n\n---\n\n")
        if tag == "a" and a.get("href") and not a["href"].startswith(("javascript:", "mailto:", "#")):
            self.link = [urljoin(self.url, a["href"]), len(self.out), len(self.md)]
        elif tag == "img":
            src = a.get("data-src") or a.get("src") or a.get("srcset", "").split(" ")[0]
            if src and not src.startswith("data:"):
                self.page.images.append((urljoin(self.url, src), a.get("alt", "")))
                self.md.append(f"![{a.get('alt', '')}]({urljoin(self.url, src)})")
        elif tag == "table":
            self.cells = []
        elif tag == "tr" and self.cells is not None:
            self.cells.append([])
        elif tag in ("td", "th") and self.cells:
            self.cells[-1].append("")
        elif tag == "pre":
            self.pre = ["", ""]
        if tag in ("pre", "code") and self.pre is not None:
            named = re.search(r"(?:language|lang|highlight)-([\w+#]+)", a.get("class", ""))
            self.pre[0] = named[1].lower() if named else self.pre[0]

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack:
            open_ = self.stack.pop()
            if self.hidden is not None and len(self.stack) <= self.hidden:
                self.hidden = None
                if open_ == tag:
                    return
            if open_ == tag:
                break
        if self.hidden is not None:
            return
        if tag in BLOCKS:
            self.out.append("\n")
        if tag in ("strong", "b"):
            self.md.append("**")
        elif tag in ("em", "i"):
            self.md.append("*")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if tag == "a" and self.link:
            href, at, md = self.link
            label = " ".join("".join(self.out[at:]).split())
            if label:
                self.page.links.append((href, label))
                self.md[md:] = [f"[{label}]({href})"]
            self.link = None
        elif tag == "table" and self.cells is not None:
            rows = [[" ".join(c.split()).replace("|", "\\|") for c in r] for r in self.cells if r]
            wide = max(map(len, rows), default=0)
            rows = [r + [""] * (wide - len(r)) for r in rows]
            self.cells = None
            if rows:
                self.page.tables.append(rows)
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                self.md.append("\n\n" + "\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]]) + "\n\n")
        elif tag == "pre" and self.pre is not None:
            self.page.code.append((self.pre[0], self.pre[1].strip("\n")))
            self.md.append(f"\n\n```{self.pre[0]}\n" + self.pre[1].strip("\n") + "\n```\n\n")
            self.pre = None

    def handle_data(self, data):
        if self.hidden is not None or any(t in ("head", "title") for t in self.stack):
            return
        self.out.append(data)
        if self.pre is not None:
            self.pre[1] += data
        elif self.cells is not None:
            if self.cells and self.cells[-1]:
                self.cells[-1][-1] += data
        else:
            self.md.append(re.sub(r"\s+", " ", data))

    def done(self) -> Page:
        lines = [" ".join(x.split()) for x in "".join(self.out).split("\n")]
        self.page.text = "\n".join(x for x in lines if x)
        self.page.markdown = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(self.md))).strip()
        return self.page


def parse(html: str | None, url: str | None = "", whole: bool = False) -> Page:
    """What a page holds; ``whole`` reads navigation and advertisements too."""
    reader = _Reader(url or "", whole)
    reader.feed(html or "")
    reader.close()
    return reader.done()


def main_content(html: str | None) -> str:
    """The first of main, article, a content element, or the body, whose text has more than ten characters."""
    for pattern in (r"(?is)<main\b.*?</main>", r"(?is)<article\b.*?</article>", r"(?is)<div[^>]+(?:id|class)=[\"'][^\"']*\bcontent\b.*", r"(?is)<body\b.*"):
        found = re.search(pattern, html or "")
        if found and len(re.sub(r"(?s)<[^>]*>|\s", "", found[0])) > 10:
            return found[0]
    return html or ""


def page_texts(pages: DataFrame, keep: list[str], html: str = "html", url: str = "url") -> DataFrame:
    """``keep`` with the clean text and Markdown of the main content."""

    def read(h, u):
        page = parse(main_content(h), u)
        yield page.text, page.markdown

    return flat_map_text(pages, html, read, "text string, markdown string", keep, (url,))


def page_links(pages: DataFrame, keep: list[str], html: str = "html", url: str = "url") -> DataFrame:
    """One row (href, label, internal) for each link of the whole page; internal: the same host and port."""
    return flat_map_text(pages, html, lambda h, u: ((href, label, urlsplit(href).netloc == urlsplit(u or "").netloc) for href, label in parse(h, u, whole=True).links), "href string, label string, internal boolean", keep, (url,))


def page_images(pages: DataFrame, keep: list[str], html: str = "html", url: str = "url") -> DataFrame:
    return flat_map_text(pages, html, lambda h, u: parse(h, u, whole=True).images, "src string, alt string", keep, (url,))


def page_tables(pages: DataFrame, keep: list[str], html: str = "html", url: str = "url") -> DataFrame:
    """One row (table_index, header, rows) for each table, rows padded to its width."""
    return flat_map_text(pages, html, lambda h, u: ((i, t[0], t[1:]) for i, t in enumerate(parse(h, u).tables)), "table_index int, header array<string>, rows array<array<string>>", keep, (url,))


def page_code(pages: DataFrame, keep: list[str], html: str = "html", url: str = "url") -> DataFrame:
    return flat_map_text(pages, html, lambda h, u: parse(h, u).code, "language string, code string", keep, (url,))


def link_counts(links: DataFrame, key: str) -> DataFrame:
    return links.groupBy(key).agg(F.count(F.lit(1)).alias("links"), F.count_if("internal").alias("internal"), F.count_distinct(domain("href")).alias("domains"))


def metadata(html: Column | str) -> dict[str, Column]:
    """Title and OpenGraph fields from the head, by expressions; a site suffix after a bar or dash is cut from the title."""
    head = F.substring(col(html), 1, 50_000)
    og = lambda p: F.nullif(F.regexp_extract(head, rf"(?is)<meta[^>]+property=[\"']og:{p}[\"'][^>]+content=[\"']([^\"']*)", 1), F.lit(""))
    title = F.nullif(F.trim(F.regexp_extract(head, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    return {"title": F.coalesce(og("title"), F.regexp_replace(title, r"\s+[|\-–—]\s+[^|\-–—]+$", "")), "description": og("description"), "image": og("image")}


# --- elements by selector -----------------------------------------------------------------------------------------------------


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    parts: list = field(default_factory=list)

    def walk(self):
        for p in self.parts:
            if isinstance(p, Element):
                yield p
                yield from p.walk()

    def text(self) -> str:
        return "".join(p.text() if isinstance(p, Element) else p for p in self.parts)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), 0)
        if at:
            del self.open[at:]

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def tree(html: str | None) -> Element:
    reader = _Tree()
    reader.feed(html or "")
    reader.close()
    return reader.root


def _fits(e: Element, simple: str) -> bool:
    tag = re.match(r"[\w-]*", simple)[0]
    marks = re.findall(r"([.#])([\w-]+)", simple)
    classes = e.attrs.get("class", "").split()
    return (not tag or e.tag == tag.lower()) and all(v in classes if m == "." else e.attrs.get("id") == v for m, v in marks)


def find_all(root: Element, selector: str) -> list[Element]:
    """Elements in document order by tag, .class, #id, their combinations, descendants (space) and alternatives (comma)."""
    found: set[int] = set()
    for one in selector.split(","):
        level = [root]
        for simple in one.split():
            level = list({id(e): e for top in level for e in top.walk() if _fits(e, simple)}.values())
        found |= {id(e) for e in level}
    return [e for e in root.walk() if id(e) in found]


def select(pages: DataFrame, config: dict[str, str | dict], keep: list[str], html: str = "html") -> DataFrame:
    """``keep`` with ``found``: for each key of ``config`` the values of its selector.

    A plain selector gives the text of all its elements. A dictionary has ``selector``, ``attr`` (``text`` or an attribute's name) and
    ``multiple``; without it only the first element counts. Elements without the attribute give null.
    """

    def read(h: str | None):
        root, out = tree(h), []
        for key, c in config.items():
            c = {"selector": c, "attr": "text", "multiple": True} if isinstance(c, str) else c
            elements = find_all(root, c["selector"])[: None if c.get("multiple") else 1]
            attr = c.get("attr", "text")
            out.append((key, [" ".join(e.text().split()) if attr == "text" else e.attrs.get(attr) for e in elements]))
        yield (out,)

    return flat_map_text(pages, html, read, "found map<string,array<string>>", keep)


def math_formulas(html: str | None) -> Iterator[tuple[str, bool, str]]:
    """(latex, display, origin) from math scripts, TeX annotations of MathML containers, and dollar signs in text; each formula once."""
    root, seen = tree(html), set()
    for e in root.walk():
        kind = e.attrs.get("type", "")
        if e.tag == "script" and "math/tex" in kind:
            formula = (e.text().strip(), "display" in kind, "script")
        elif e.tag == "annotation" and "tex" in e.attrs.get("encoding", "").lower():
            formula = (e.text().strip(), False, "annotation")
        else:
            continue
        if formula[0] and formula[0] not in seen:
            seen.add(formula[0])
            yield formula
    plain = "".join(_visible(root))
    for m in re.finditer(r"(?s)\$\$(.+?)\$\$|(?<![\w$\\])\$(?!\s)([^$\n]+?)(?<!\s)\$(?![\w$])", plain):
        latex = (m[1] or m[2]).strip()
        if latex and latex not in seen:
            seen.add(latex)
            yield latex, m[1] is not None, "text"


def _visible(e: Element) -> Iterator[str]:
    for p in e.parts:
        if not isinstance(p, Element):
            yield p
        elif p.tag not in UNSEEN and p.tag not in ("pre", "code", "annotation"):
            yield from _visible(p)


def page_math(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    return flat_map_text(pages, html, math_formulas, "latex string, display boolean, origin string", keep)
