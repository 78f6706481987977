"""Markdown documents and feeds: fences, structure reports, pseudocode scores, formatting, slices and their assets."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.functions.columns import col
from millrace.operators.textmap import flat_map_text

# Fixed patterns.
HEADING = r"(?m)^ {0,3}#{1,6}\s"
LINK_TARGET = r"\]\(\s*(<[^>]*>|[^)\s]+)"
BARE_URL = r"""https?://[^\s)\]>'"]+"""
ALGORITHM_TITLE = r"(?i)^(?:Algorithm|Procedure|Function|Subroutine|Listing)\s+\d+"
STRUCTURED_HEADER = r"(?im)^(?:Require|Ensure|Input|Output|Precondition|Postcondition)\s*:"
NUMBERED_LINE = r"^\s*\d+\s*:\s+\S"
KEYWORD_LINE = r"(?i)(?:^|\s)(?:if\b|then\b|else\b|end\s+(?:if|for|while|function|procedure|loop)\b|for\s+(?:each|all)?\b|while\b|\bdo\b|repeat\b|until\b|return\b|function\b|procedure\b|begin\b|call\b)"
SPECIAL = r"[←→≠≤≥∅▷◃∈∉∀∃⊂⊃∪∩∧∨≜≝≐⊕⊗]"
TABLE_RULE = r"(?m)^\|[\s-]+\|"
SCORE_THRESHOLD = 5
ATOM = "{http://www.w3.org/2005/Atom}"

_FENCE = re.compile(r"(?ms)^ {0,3}(?P<mark>`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}(?P=mark)[`~]*[ \t]*(?:\n|\Z)|\Z)")


def fences(text: str | None) -> list[str]:
    """Fenced blocks with their fence lines, in order; one that is never closed goes to the end."""
    return [m[0] for m in _FENCE.finditer(text or "")]


def restore_fences(text: str, source: list[str]) -> tuple[str, bool]:
    """Each fenced block of ``text`` replaced by the source's of the same place; left as it is, and false, if their numbers differ."""
    if len(fences(text)) != len(source):
        return text, False
    blocks = iter(source)
    return _FENCE.sub(lambda m: next(blocks), text), True


def restored(docs: DataFrame, source: str, translated: str, keep: list[str]) -> DataFrame:
    """``keep`` with ``restored`` and ``restorable``: the translation with the source's fenced blocks."""
    return flat_map_text(docs, translated, lambda t, s: [restore_fences(t or "", fences(s))], "restored string, restorable boolean", keep, (source,))


def _targets(text: Column) -> Column:
    links = F.transform(F.regexp_extract_all(text, F.lit(LINK_TARGET), F.lit(1)), lambda t: F.regexp_replace(t, "^<+|>+$", ""))
    return F.concat(links, F.regexp_extract_all(text, F.lit(BARE_URL), F.lit(0)))


def structure_report(source: Column | str, translated: Column | str) -> dict[str, Column]:
    """What a translation lost: heading and image counts, URLs with the times each is missing, and whether that is fatal."""
    src, dst = (F.coalesce(col(c), F.lit("")) for c in (source, translated))
    headings = lambda t: F.size(F.regexp_extract_all(t, F.lit(HEADING), F.lit(0)))
    images = lambda t: ((F.length(t) - F.length(F.replace(t, F.lit("!["), F.lit("")))) / 2).cast("int")
    a, b = _targets(src), _targets(dst)
    times = lambda urls, u: F.size(F.filter(urls, lambda x: x == u))
    missing = F.array_sort(F.flatten(F.transform(F.array_distinct(a), lambda u: F.array_repeat(u, F.greatest(F.lit(0), times(a, u) - times(b, u))))))
    lost = F.greatest(F.lit(0), images(src) - images(dst))
    return {
        "headings_src": headings(src),
        "headings_dst": headings(dst),
        "images_missing": lost,
        "urls_missing": missing,
        "drift": headings(src) != headings(dst),
        "fatal": (lost > 0) | (F.size(missing) > 0),
    }


def algorithm_score(text: Column | str) -> Column:
    """How much a block looks like pseudocode; SCORE_THRESHOLD or more is taken for it. Null and blank texts score 0."""
    t = F.coalesce(col(text), F.lit(""))
    whole = F.regexp_replace(t, r"^\s+", "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"\S"))
    n = F.size(lines)
    titled, headed = whole.rlike(ALGORITHM_TITLE), t.rlike(STRUCTURED_HEADER)
    numbered = F.size(F.filter(lines, lambda x: x.rlike(NUMBERED_LINE)))
    keywords = F.size(F.filter(lines, lambda x: x.rlike(KEYWORD_LINE)))
    special = F.size(F.regexp_extract_all(t, F.lit(SPECIAL), F.lit(0)))
    mean = F.aggregate(lines, F.lit(0), lambda acc, x: acc + F.length(x)) / F.nullif(n, F.lit(0))
    points = lambda c, p: F.when(c, p).otherwise(0)
    score = (
        points(titled, 5)
        + points(headed, 3)
        + F.least(numbered, F.lit(5))
        + F.least(keywords, F.lit(5))
        + points(special >= 2, 2)
        - points(mean > 120, 3)
        - points((n < 3) & ~titled, 2)
        - points(~(titled | headed | (numbered >= 2) | (special >= 2)), 4)
    )
    return F.when((n == 0) | t.rlike(TABLE_RULE), F.lit(0)).otherwise(score)


def _format_prose(text: str) -> str:
    text = re.sub(r"(?m)[ \t]+$", "", text)
    text = re.sub(r"(?m)^( {0,3}#{1,6})([^#\s])", r"\1 \2", text)  # a space after the marks of a heading
    text = re.sub(r"(?m)^( *)[*+](?=[ \t]+\S)", r"\1-", text)  # one list mark
    text = re.sub(r"(?m)^( *\d+)\)(?=[ \t]+\S)", r"\1.", text)
    text = re.sub(r"(?m)^>(?=[^\s>])", "> ", text)
    text = re.sub(r"(?m)([^\n])\n( {0,3}#{1,6} )", r"\1\n\n\2", text)  # headings stand alone
    text = re.sub(r"(?m)^( {0,3}#{1,6} [^\n]+)\n(?=[^\n])", r"\1\n\n", text)
    text = re.sub(r"(!?)\[([^\]]*)\]\(\s+([^)]*?)\s*\)", r"\1[\2](\3)", text)
    text = re.sub(r"(?<=\w)  +(?=\w)", " ", text)
    return re.sub(r"\n{3,}", "\n\n", text)


def format_markdown(text: str | None) -> str:
    """Headings, lists, quotes, links, spaces and blank lines in one form; fenced code, inline code and math stay as they are."""
    kept: list[str] = []
    mark = "\x00"
    while mark in (text or ""):
        mark += "\x00"

    def hold(m: re.Match) -> str:
        kept.append(m[0])
        return f"{mark}{len(kept) - 1}{mark}" + ("\n" if m[0].endswith("\n") else "")

    held = _FENCE.sub(hold, text or "")
    held = re.sub(r"(?s)\$\$.+?\$\$|`[^`\n]+`|(?<![\w$])\$[^$\n]+\$(?![\w$])", hold, held)
    formed = _format_prose(held)
    for i in reversed(range(len(kept))):
        held = f"{mark}{i}{mark}" + ("\n" if kept[i].endswith("\n") else "")
        formed = formed.replace(held if held in formed else f"{mark}{i}{mark}", kept[i])
    return formed.strip("\n") + "\n" if formed.strip() else ""


def formatted(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return flat_map_text(docs, text, lambda t: [(format_markdown(t),)], "formatted string", keep)


def page_ranges(rows: DataFrame, pages: str, batch: int) -> DataFrame:
    """One row (start, end) for each slice of ``batch`` pages of each row, end exclusive; rows without pages have none."""
    starts = F.sequence(F.lit(0), F.col(pages) - 1, F.lit(batch))
    return rows.where(F.col(pages) > 0).withColumn("start", F.explode(starts)).withColumn("end", F.least(F.col("start") + batch, F.col(pages)))


def merge_assets(assets: DataFrame, document: str, slice_: str, name: str, sha: str, order: list[str]) -> DataFrame:
    """Assets with ``new_name``: of one name, those of the first one's content go, those of another content get the slice before it.

    The first is the least by slice, then ``order``, then hash, so only rows equal in all of them tie, and these are alike. Where a
    hash is null (an unreadable file) contents can't be told to be equal: such an asset stays, renamed unless it is the first.
    """
    by_name = W.Window.partitionBy(document, name).orderBy(slice_, *order, F.col(sha).asc_nulls_last())
    marked = assets.withColumn("__first", F.first(sha).over(by_name)).withColumn("__n", F.row_number().over(by_name))
    kept = marked.where((F.col("__n") == 1) | F.coalesce(F.col(sha) != F.col("__first"), F.lit(True)))
    renamed = F.when(F.col("__n") == 1, F.col(name)).otherwise(F.concat(F.lit("b"), F.col(slice_).cast("string"), F.lit("_"), F.col(name)))
    return kept.withColumn("new_name", renamed).drop("__first", "__n")


def _entries(xml: str | None, since: str | None) -> Iterator[tuple]:
    try:
        root = ET.fromstring(xml or "<feed/>")
    except ET.ParseError:
        return
    atom = root.tag == f"{ATOM}feed"
    for e in root.iter(f"{ATOM}entry" if atom else "item"):
        text = lambda tag, e=e: " ".join((e.findtext(f"{ATOM}{tag}" if atom else tag) or "").split())
        published = text("published" if atom else "pubDate")
        if since and re.match(r"\d{4}-\d{2}-\d{2}", published) and published[:10] < since[:10]:
            continue
        id_ = text("id" if atom else "guid")
        short = id_.rpartition("/abs/")[2]
        links = e.findall(f"{ATOM}link")
        pdf = next((x.get("href", "") for x in links if x.get("title") == "pdf"), "")
        authors = [n for a in e.findall(f"{ATOM}author") if (n := (a.findtext(f"{ATOM}name") or "").strip())]
        yield short, text("title"), text("summary" if atom else "description"), authors, pdf, published


def feed_records(feeds: DataFrame, xml: str, keep: list[str], since: str | None = None) -> DataFrame:
    """One row for each entry of an Atom or RSS feed; entries published before the day ``since`` are left out, unreadable dates kept."""
    return flat_map_text(feeds, xml, lambda x: _entries(x, since), "id string, title string, summary string, authors array<string>, pdf_url string, published string", keep)


def missing_links(source: DataFrame, target: DataFrame, key: str, link: str) -> DataFrame:
    """(key, link) of ``source`` that ``target`` lacks, as often as it lacks them: a link held twice and kept once is missing once."""
    return source.select(key, link).exceptAll(target.select(key, link))
