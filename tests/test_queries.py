"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from millrace import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, np.ndarray | list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, float | np.floating):
        return None if v != v else int(v) if float(v).is_integer() else round(float(v), 9)
    if isinstance(v, np.integer):
        return int(v)
    return v


def rows(frame):
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, sf, duck, name):
    out = core.QUERIES[name](spark, sf).toPandas()
    if name in core.SQL:
        want = duck.execute(core.SQL[name]).df()
        assert sorted(out.columns) == sorted(want.columns)
        assert rows(out) == rows(want)


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_all_sql_belongs_to_a_query():
    assert set(core.SQL) <= set(core.QUERIES)
    assert os.path.isdir("/root/testdata/sf0.001")


def test_more_lines_give_more_partitions_of_the_same_edges(spark, sf, monkeypatch):
    from millrace.queries import graph

    want = sorted(tuple(r) for r in graph._joined(spark, sf).select("source", "target", "type", "weight").collect())
    monkeypatch.setattr(graph, "LINES", 200)
    split = graph._joined(spark, sf)
    assert split.rdd.getNumPartitions() > 8
    assert sorted(tuple(r) for r in split.select("source", "target", "type", "weight").collect()) == want
    assert not any("parts" in name for name in graph.QUERIES)


def test_sentence_counts_of_empty_and_null_texts(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM (VALUES (1, ''), (2, NULL), (3, '  \n '), (4, 'a. b'), (5, '...')) d(doc_id, text)) TO '{tmp_path}/documents.parquet'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    out = core.QUERIES["sentence_counts"](spark, str(tmp_path)).toPandas()
    assert rows(out) == rows(con.execute(core.SQL["sentence_counts"]).df())
