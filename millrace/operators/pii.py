"""Personal data: detection with spans, masking, and access by role."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import lookup
from millrace.operators.textmap import flat_map_text

# Fixed patterns, in order of precedence.
PATTERNS = (
    ("id_card", r"(?<!\d)\d{17}[\dXx](?!\d)"),
    ("credit_card", r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("phone", r"(?<!\d)(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}(?!\d)"),
    ("phone", r"(?<!\d)1[3-9]\d{9}(?!\d)"),
)
ROLES = {"viewer": 0, "editor": 1, "admin": 2}
POLICIES = ("mark", "mask", "anonymize")
_COMPILED = tuple((k, re.compile(p)) for k, p in PATTERNS)


def luhn(value: str) -> bool:
    digits = [int(c) for c in value if c in "0123456789"]
    doubled = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
    return len(digits) >= 13 and (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start: the matches that don't start inside one of higher precedence.

    All matches are laid out by start at once. ``reach[p]`` is how far the kept matches of pattern p extend so far, so whether a match
    starts inside one of higher precedence is told by the patterns before its own, whatever the number of matches.
    """
    text = text or ""
    laid = [(m.start(), p, m.end(), kind) for p, (kind, pattern) in enumerate(_COMPILED) for m in pattern.finditer(text) if kind != "credit_card" or luhn(m[0])]
    reach, kept = [-1] * len(_COMPILED), []
    for start, p, end, kind in sorted(laid):
        if start >= max(reach[:p], default=-1):
            reach[p] = max(reach[p], end)
            kept.append((kind, start, end))
    return kept


def apply_policy(text: str | None, found: list[tuple[str, int, int]], policy: str = "mask", head: int = 2, tail: int = 2) -> str | None:
    """Text as it is, with the middle of each span starred, or with the span's kind in its place; overlapping spans are skipped."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    if policy == "mark" or not text:
        return text
    out, at = "", 0
    for kind, a, b in sorted(found, key=lambda s: s[1]):
        if a < at:
            continue
        value = text[a:b]
        stars = max(0, len(value) - head - tail)
        masked = value[:head] + "*" * stars + value[len(value) - tail :] if stars else "*" * len(value)
        out += text[at:a] + (masked if policy == "mask" else f"<{kind.upper()}>")
        at = b
    return out + text[at:]


def detect(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with one row (kind, start, end) for each span."""
    return flat_map_text(docs, text, spans, "kind string, start int, `end` int", keep)


def redact(docs: DataFrame, keep: list[str], text: str = "text", policy: str = "mask") -> DataFrame:
    return flat_map_text(docs, text, lambda t: [(apply_policy(t, spans(t), policy),)], "redacted string", keep)


def counts(text: Column | str) -> dict[str, Column]:
    """Counts of kinds that need no offsets, as plain expressions."""
    c = F.col(text) if isinstance(text, str) else text
    cards = F.regexp_extract_all(c, F.lit(PATTERNS[1][1]), F.lit(0))
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    return {
        "emails": F.regexp_count(c, F.lit(PATTERNS[2][1])),
        "id_cards": F.regexp_count(c, F.lit(PATTERNS[0][1])),
        "cards": F.size(F.filter(cards, lambda x: F.call_function("luhn_check", digits(x)))),
    }


def gate(rows: DataFrame, role: str, text: str, redacted: str, least: str = "editor") -> DataFrame:
    """Roles under ``least`` see the redacted text."""
    allowed = lookup(F.lit(role), {k: float(v) for k, v in ROLES.items()}, -1.0) >= float(ROLES[least])
    return rows.withColumn("visible", F.when(allowed, F.col(text)).otherwise(F.coalesce(redacted, text)))
