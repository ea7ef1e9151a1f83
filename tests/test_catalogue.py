"""Every query against its SQL on the smallest tables, where those are there."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v) if isinstance(v, datetime.datetime) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, sql, name):
    df = entry.queries()[name](spark, SMALL)
    result = sql.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


PRODUCTS = ("knn_semantic", "knn_centroid", "retrieval_metrics", "retrieval_metrics_tvd", "reference_assessments", "retrieval_reference", "context_precision_ranked", "resolve_text_units")  # of matrices, and a sweep
NATIVE = [n for n in entry.queries() if n not in ("markdown_chunks", "kmeans_sample", "pipeline", *PRODUCTS) and not n.startswith("op")]


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_in_the_plans(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
