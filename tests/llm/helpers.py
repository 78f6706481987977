"""Small document tables with every awkward case: nulls in any column, empty and long texts, ties, repeated rows."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(6000))


def awkward(extra: list[tuple] = ()) -> list[tuple]:
    rows = [
        (1, "The cat sat on the mat and looked at the moon", "en", "a", 45),
        (2, "The cat sat on the mat and looked at the moon", "en", "a", 45),
        (2, "The cat sat on the mat and looked at the moon", "en", "a", 45),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, " \t\n ", "de", "b", 4),
        (6, LONG, "en", "b", len(LONG)),
        (7, "1234 5678 !!!", "fr", None, 13),
        (None, "nobody knows this row", "en", "c", 21),
        (8, "ß Straße Ünïcode 漢字 😀 ſecret", "de", "c", 30),
    ]
    return [*rows, *extra]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)
