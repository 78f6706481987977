"""Text column functions: tokens, sentences, names, parsers and cheap quality scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.columns import col

# Fixed values.
SENTENCE_ENDS = "。！？；.!?;\\n"
LEGAL_SUFFIX = r"(?i)\s*\b(inc|llc|ltd|corp|corporation|co|gmbh|ag|sa|nv|bv|pte|srl|plc|limited|company)\b\.?\s*$"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CJK = r"[一-鿿]"


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_set(text: Column | str) -> Column:
    return F.array_distinct(tokens(text))


def has_all_terms(text: Column | str, terms: list[str]) -> Column:
    """Every term is a token of the text (AND query); no terms match nothing."""
    if not terms:
        return F.lit(False)
    return F.size(F.array_except(F.array(*map(F.lit, terms)), tokens(text))) == 0


def term_count(text: Column | str, terms: list[str]) -> Column:
    """Number of tokens that are one of the terms."""
    return F.size(F.filter(tokens(text), lambda t: t.isin(terms)))


def sentences(text: Column | str) -> Column:
    """Trimmed sentences with their delimiters; empty ones dropped."""
    pattern = f"[^{SENTENCE_ENDS}]*[{SENTENCE_ENDS}]|[^{SENTENCE_ENDS}]+$"
    parts = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(pattern), F.lit(0))
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def sentences_by_space(text: Column | str) -> Column:
    """Split on white space that follows a sentence end."""
    return F.filter(F.split(col(text), r"(?<=[.!?。！？])\s+", -1), lambda s: F.trim(s) != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def normalize_label(label: Column | str) -> Column:
    """Lower case, single spaces, no legal suffix, no separators."""
    x = F.regexp_replace(F.lower(F.trim(col(label))), r"\s+", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(x, LEGAL_SUFFIX, "")), r"[,.\-–—]", "")


def blocking_key(label: Column | str, kind: Column | str) -> Column:
    return F.concat(F.substring(normalize_label(label), 1, 3), F.lit("|"), F.coalesce(col(kind), F.lit("other")))


def query_hash(text: Column | str) -> Column:
    """First 32 hexadecimal digits of the SHA-1 of the lower-cased text with single spaces."""
    return F.substring(F.sha1(F.trim(F.regexp_replace(F.lower(col(text)), r"\s+", " "))), 1, 32)


def slugify(text: Column | str, default: str = "untitled") -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(default))


def snippet(text: Column | str, size: int = 500) -> tuple[Column, Column]:
    """First characters, and whether there are more."""
    return F.substring(col(text), 1, size), F.length(col(text)) > size


def cjk_ratio(text: Column | str) -> Column:
    ink = F.regexp_replace(col(text), r"\s", "")
    return F.coalesce(F.try_divide(F.length(ink) - F.length(F.regexp_replace(ink, CJK, "")), F.length(ink)), F.lit(0.0))


def emails(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit(EMAIL), F.lit(0)))


def domain(url: Column | str) -> Column:
    """Host with port, lower-cased."""
    return F.lower(F.nullif(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]+)", 1), F.lit("")))


def clean_text(text: Column | str) -> Column:
    """Runs of white space become one space."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def count(text: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(text), F.lit(pattern))


def markdown_to_text(text: Column | str) -> Column:
    """Strip Markdown marks: fences, code, images, links, headings, emphasis, quotes, bullets, rules."""
    x = col(text)
    for pattern, put in (
        (r"(?s)```.*?```", ""),
        (r"`([^`]*)`", "$1"),
        (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(?m)^#{1,6}[ \t]+", ""),
        (r"(\*\*|__)(.*?)\1", "$2"),
        (r"(\*|_)(.*?)\1", "$2"),
        (r"(?m)^>\s?", ""),
        (r"(?m)^[ \t]*[-*+][ \t]+", ""),
        (r"(?m)^[ \t]*\d+\.[ \t]+", ""),
        (r"(?m)^(-{3,}|\*{3,}|_{3,})$", ""),
        (r"\n{3,}", "\n\n"),
    ):
        x = F.regexp_replace(x, pattern, put)
    return F.trim(x)


def content_quality(markdown: Column | str) -> Column:
    """Words .001, headings 5, table lines 3, block formulas 10, inline ones 2, fences 5, images 3."""
    t = col(markdown)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return (
        words * 0.001
        + count(t, r"(?m)^#{1,6}\s") * 5
        + count(t, r"(?m)^\|.*\|$") * 3
        + count(t, r"\$\$[^$]+\$\$") * 10
        + count(t, r"(?<!\$)\$[^$\n]+\$(?!\$)") * 2
        + count(t, r"(?m)^```") * 5
        + count(t, r"!\[[^\]]*\]\([^)]*\)") * 3
    ).cast("double")


def structured_share(text: Column | str) -> Column:
    """Share of non-empty lines that are bullets, numbered items, headings or table rows."""
    lines = F.filter(F.split(F.coalesce(col(text), F.lit("")), "\n", -1), lambda s: F.trim(s) != "")
    marked = F.filter(lines, lambda s: s.rlike(r"^\s*([-*+]\s|\d+[.)]\s|#{1,6}\s|\|)"))
    return F.coalesce(F.try_divide(F.size(marked), F.size(lines)), F.lit(0.0))


def repetition(text: Column | str) -> Column:
    """Share of words that stood in the text before."""
    w = tokens(text)
    return F.coalesce(F.lit(1.0) - F.try_divide(F.size(F.array_distinct(w)), F.size(w)), F.lit(0.0))


def initial_retention(text: Column | str, type_factor: Column | float = 1.0, has_facts: Column | bool = False, base: float = 0.8) -> Column:
    """Starting retention of a memory: share of different words, length up to 50 words, type and supporting facts; at most 1."""
    w = F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"\s+"), lambda t: t != "")
    n = F.size(w)
    unique = F.coalesce(F.try_divide(F.size(F.array_distinct(w)), n), F.lit(0.0))
    factor = type_factor if isinstance(type_factor, Column) else F.lit(float(type_factor))
    facts = has_facts if isinstance(has_facts, Column) else F.lit(has_facts)
    score = (F.lit(base) * (F.lit(0.5) + unique * 0.5) + F.least(F.lit(1.0), n / 50.0) * 0.2) * factor + F.when(facts, 0.1).otherwise(0.0)
    return F.when(n == 0, F.lit(0.5)).otherwise(F.least(F.lit(1.0), score))
