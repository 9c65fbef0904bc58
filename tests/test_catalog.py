"""Every query against its SQL on the smallest tables, and the rules queries keep to."""

from __future__ import annotations

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as spark_entry
from tidemark import catalog
from tidemark.catalog.inputs import TABLES

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def judge():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def canonical(rows):
    return sorted(tuple("" if v is None else f"{type(v).__name__}:{v}" for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, judge, name):
    df = QUERIES[name](spark, DATA)
    order = sorted(df.columns)
    got = canonical(tuple(r) for r in df.select(*order).collect())
    if name not in SQL:
        assert got
        return
    result = judge.execute(SQL[name])
    columns = [d[0] for d in result.description]
    want = canonical(tuple(r[columns.index(c)] for c in order) for r in result.fetchall())
    assert sorted(columns) == order and got == want and want


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.columns and df.count() > 0


def test_all_sql_belongs_to_queries():
    assert set(QUERIES) <= set(spark_entry.queries()) and set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
    assert set(SQL) <= set(QUERIES) and len(QUERIES) - len(SQL) <= 1


@pytest.mark.parametrize("name", ["snapshot_diff", "apply_changes", "condition_transitions", "batch_plan", "drift_report"])
def test_plans_stay_in_the_jvm_without_cross_joins(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan
    assert not re.search(r"Exchange SinglePartition(?!.*Aggregate)", plan)


@pytest.mark.parametrize("name", ["index_counts", "change_counts", "run_counts"])
def test_scans_read_only_what_they_need(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        assert "n_chars" not in schema and "props" not in schema
