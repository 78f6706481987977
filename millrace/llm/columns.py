"""Columns that an operator only passes on, under any names."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parameters of operators that name a column they read.
READ = ("text", "doc_id", "source", "repository", "owner")


def free_prefix(columns: list[str], names: list[str], prefix: str = "") -> str:
    """``prefix``, or the first longer one with which no name is a column's; letter case makes no difference to Spark."""
    taken = {c.lower() for c in columns}
    while any((prefix + n).lower() in taken for n in names):
        prefix = f"new_{prefix}"
    return prefix


def _quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def keeping(*outputs: str, all_columns: bool = False) -> Callable:
    """For an operator with parameters ``docs``, ``keep`` and ``prefix`` that adds ``outputs``: columns of ``keep`` may have any name.

    They pass through the operator under names that nothing else has and get their own back at the end. Where ``keep`` isn't
    given, it is ``doc_id``, or all columns for operators without one and with ``all_columns``. A name of ``keep`` that output's in any letter case is refused before any work.
    """

    def wrap(operator: Callable) -> Callable:
        signature = inspect.signature(operator)

        @wraps(operator)
        def run(*args, **kwargs) -> DataFrame:
            call = signature.bind(*args, **kwargs)
            call.apply_defaults()
            given = call.arguments
            docs: DataFrame = given["docs"]
            read = [given[p] for p in READ if isinstance(given.get(p), str)]
            keep = given["keep"] if given["keep"] is not None else [given["doc_id"]] if "doc_id" in given and not all_columns else docs.columns
            new = {(given["prefix"] + x).lower() for x in outputs}
            if clash := new & {c.lower() for c in keep}:
                raise ValueError(f"columns {sorted(clash)} exist; give a prefix")
            if all(c in read for c in keep):
                given["keep"] = keep
                return operator(*call.args, **call.kwargs)
            inner = [c if c in read else f"kept_{i}" for i, c in enumerate(keep)]
            given["docs"] = docs.select(*[_quoted(c) for c in dict.fromkeys(read)], *[_quoted(c).alias(i) for c, i in zip(keep, inner, strict=True) if c not in read])
            given["keep"] = inner
            out = operator(*call.args, **call.kwargs)
            back = dict(zip(inner, keep, strict=True))
            return out.toDF(*[back.get(c, c) for c in out.columns])

        return run

    return wrap
