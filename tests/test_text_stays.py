"""Text is not shuffled where ids, places and hashes do: writes of few indexes, reads after many changes, content of changed files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators.changes import changed_files, likely_rows
from tidemark.operators.documents import url_documents
from tidemark.plans.index_table import FEW_INDEXES, IndexTable
from tidemark.plans.sync_all import path_columns, sync_all
from tidemark.session import cut, scratch_path


def at():
    return F.lit("2024-01-01").cast("timestamp")


def docs(spark, n, index="'i'", text="'t'"):
    rows = spark.range(n).selectExpr("CAST(id AS STRING) AS url", f"{text} AS text", f"{index} AS name")
    return url_documents(rows, index_name=F.col("name"), owner="o", run_ts=at())


@pytest.fixture
def index(spark):
    return IndexTable(spark, scratch_path(spark, "index"))


@pytest.fixture
def low(spark):
    """Only what is very small is broadcast, as if all else were large."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "12k")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_write_their_own_rows_of_few_indexes(spark, index):
    index.index_documents(docs(spark, 300).repartition(3))
    assert len(index.read().inputFiles()) == 3
    index.compact()
    assert index.read().count() == 300
    many = IndexTable(spark, scratch_path(spark, "index"))
    many.index_documents(docs(spark, 400, f"'i' || id % {FEW_INDEXES + 1}").repartition(5))
    assert len(many.read().inputFiles()) == FEW_INDEXES + 1 and many.read().count() == 400


def test_names_of_a_later_commit_are_those_of_the_folders(spark, index):
    index.index_documents(docs(spark, 5))
    never = docs(spark, 5).withColumn("index_name", F.raise_error(F.lit("looked at")).cast("string"))
    assert index._n_indexes(never) == 1


def test_reading_after_many_changes_shuffles_no_text(spark, index, low):
    index.index_documents(docs(spark, 3000))
    index.update_documents(docs(spark, 2000, text="'new' || id"))
    index.delete_documents(docs(spark, 500))
    df = index.read()
    assert "BroadcastHashJoin" in plan(df) and "SortMergeJoin" not in plan(df) and "Exchange hashpartitioning" not in plan(df)
    want = {str(i): f"new{i}" if i < 2000 else "t" for i in range(500, 3000)}
    assert {r.source_uri: r.text for r in df.collect()} == want


def test_only_content_of_changed_files_goes_on_to_the_join(spark):
    files = spark.range(4000).selectExpr("'o' AS owner", "'p' || id AS path", "'x' || id AS content")
    wanted = files.where("CAST(substr(path, 2) AS INT) % 40 = 7").select("owner", "path")
    got = likely_rows(files, wanted, ["owner", "path"])
    assert got.columns == files.columns and 100 <= got.count() <= 103 and got.join(wanted, ["owner", "path"]).count() == 100
    # a null is wanted by nobody, copies come once
    odd = spark.createDataFrame([("p1", "c"), (None, "n"), ("p2", "d")], "path string, content string")
    resolved = spark.createDataFrame([("update", "p1", "id1", "modified"), ("update", None, "id2", "modified"), ("delete", "p2", "id3", None)], "action string, b_path string, doc_id string, change_label string")
    assert [tuple(r) for r in changed_files(odd, resolved).collect()] == [("p1", "c", "id1", "modified")]
    assert "LeftSemi" in plan(changed_files(files, wanted.selectExpr("'update' AS action", "path AS b_path", "path AS doc_id", "'m' AS change_label")))


def test_one_job_for_all_sources_joins_content_of_changed_files_only(spark, index, monkeypatch, low):
    def version(name, text):
        return spark.range(40).selectExpr("'o' || id % 2 AS owner", f"'{name}' AS version", "'p' || id || '.md' AS path", f"CAST({text} AS BINARY) AS content")

    captures = cut(version("v1", "'x' || id").unionByName(version("v2", "CASE WHEN id % 5 = 0 THEN 'new' || id ELSE 'x' || id END")), "captures", "owner", "version")
    specs = spark.createDataFrame([("o0", "i"), ("o1", "i")], "owner string, index_name string").withColumns(
        {"repository": F.lit("r"), "branch": F.lit("b"), "version": F.lit("v1"), "checkpoint": F.lit(None).cast("string"), **path_columns()}
    )
    sync_all(index, captures, specs, at())
    plans, apply = [], index.apply

    def spied(**given):
        plans.append(plan(given["upserts"]))
        return apply(**given)

    monkeypatch.setattr(index, "apply", spied)
    sync_all(index, captures, specs.withColumns({"version": F.lit("v2"), "checkpoint": F.lit("v1")}), at())
    assert "LeftSemi" in plans[0] and "_mask" in plans[0]
    assert {r.source_uri: r.text for r in index.read().collect()} == {f"p{i}.md": f"{'new' if i % 5 == 0 else 'x'}{i}" for i in range(40)}
