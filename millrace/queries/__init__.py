"""Registered queries of the library's own operators over the bundled tables, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("search", "relational", "graph", "text", "memory", "lifecycle", "lineage", "storage", "intervals")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"millrace.queries.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
