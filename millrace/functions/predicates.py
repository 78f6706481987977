"""Filters over metadata, validity intervals and access lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.columns import col


def json_value(doc: Column | str, path: str, kind: str = "string") -> Column:
    """Scalar at a path of a JSON string; null for malformed documents, absent paths and failed casts."""
    return F.try_variant_get(F.try_parse_json(col(doc)), path, kind)


def active(metadata: Column | str) -> Column:
    return ~F.coalesce(json_value(metadata, "$.archived", "boolean"), F.lit(False))


def searchable(metadata: Column | str) -> Column:
    return F.coalesce(json_value(metadata, "$.searchable", "boolean"), F.lit(True))


def not_deleted(metadata: Column | str) -> Column:
    return ~json_value(metadata, "$.deleted").eqNullSafe("true")


def json_contains(doc: Column | str, wanted: dict | list | str | int | float | bool | None) -> Column:
    """Containment of a (constant) JSON value: objects by key, arrays by element, scalars by equality.

    The wanted value is unfolded when the plan is built, so each of its parts is an ordinary expression.
    """
    return F.coalesce(_variant_contains(F.try_parse_json(col(doc)), wanted), F.lit(False))


def _variant_contains(v: Column, wanted) -> Column:
    kind = F.schema_of_variant(v)
    if isinstance(wanted, dict):
        found = kind.startswith("OBJECT")
        for key, inner in wanted.items():
            found = found & _variant_contains(F.try_variant_get(v, f"$['{key}']", "variant"), inner)
        return found
    if isinstance(wanted, list):
        found = kind.startswith("ARRAY")
        elements = F.try_variant_get(v, "$", "array<variant>")
        for inner in wanted:
            found = found & F.exists(elements, _element_test(inner))
        return found
    if wanted is None:
        return F.is_variant_null(v)
    if isinstance(wanted, bool):
        return kind.eqNullSafe("BOOLEAN") & F.try_variant_get(v, "$", "boolean").eqNullSafe(wanted)
    if isinstance(wanted, int | float):
        return ~F.coalesce(kind.isin("STRING", "BOOLEAN"), F.lit(True)) & F.try_variant_get(v, "$", "double").eqNullSafe(float(wanted))
    return kind.eqNullSafe("STRING") & F.try_variant_get(v, "$", "string").eqNullSafe(wanted)


def _element_test(wanted):
    return lambda e: F.coalesce(_variant_contains(e, wanted), F.lit(False))


def valid_at(start: Column | str, end: Column | str, at: Column) -> Column:
    """Half-open validity; null ends are open."""
    return (col(start).isNull() | (col(start) <= at)) & (col(end).isNull() | (col(end) > at))


def contains_text(text: Column | str, needle: str) -> Column:
    """Substring without regard to case; wildcards in the needle are plain characters."""
    return F.contains(F.lower(col(text)), F.lit(needle.lower()))


def allowed(roles: Column | str, users: Column | str, role: str, user: str) -> Column:
    """Access list decision: no lists at all, a wildcard, or a listed role or user."""
    roles, users = F.coalesce(col(roles), F.array().cast("array<string>")), F.coalesce(col(users), F.array().cast("array<string>"))
    open_ = (F.size(roles) == 0) & (F.size(users) == 0)
    return open_ | F.arrays_overlap(roles, F.array(F.lit("*"), F.lit(role))) | F.arrays_overlap(users, F.array(F.lit("*"), F.lit(user)))


def natural_language(content: Column | str) -> Column:
    """Not a JSON object of two keys or more."""
    return ~F.coalesce(F.size(F.json_object_keys(F.when(F.try_parse_json(col(content)).isNotNull(), col(content)))) >= 2, F.lit(False))
