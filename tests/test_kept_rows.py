"""Rows that earlier versions lost: nulls, sizes, moved files whose old path is used again, failed counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.drift import drift_report, drift_tally, update_drift_flags
from tidemark.operators.numbering import number_rows
from tidemark.operators.status import close_runs
from tidemark.plans.index_table import IndexTable
from tidemark.plans.sync import FileSource, sync_files
from tidemark.session import scratch_path
from tidemark.sources.trees import land_snapshot, oversized_files, read_tree

STATUS = "owner string, index_name string, policy string, phase string, suspend boolean, expected long, count_failed boolean"


def test_a_null_is_numbered_like_any_other_value(spark):
    df = spark.createDataFrame([("k", None), ("k", "a"), (None, None)], "key string, id string")
    got = sorted((r.key or "", r.position) for r in number_rows(df, ["key"], "id").collect())
    assert got == [("", 1), ("k", 1), ("k", 2)]


def test_large_files_stay_or_leave_an_error_row(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"x")
    (tmp_path / "big.md").write_bytes(b"x" * 50)
    (tmp_path / "big.so").write_bytes(b"x" * 50)
    assert {r.path for r in read_tree(spark, str(tmp_path), include=["*.md"]).collect()} == {"a.md", "big.md"}
    errors = oversized_files(spark, str(tmp_path), 40, include=["*.md"]).collect()
    assert [tuple(r) for r in errors] == [("big.md", "File too large: exceeds limit of 40 bytes")]


def test_a_new_file_at_the_path_of_a_moved_one(spark):
    root, table = scratch_path(spark, "captures"), IndexTable(spark, scratch_path(spark, "index"))
    versions = {"v1": {"a": "one"}, "v2": {"b": "one"}, "v3": {"b": "one", "a": "two"}, "v4": {"c": "one", "b": "two", "a": "three"}}
    for name, files in versions.items():
        land_snapshot(spark.createDataFrame([(f"{p}.md", t.encode()) for p, t in files.items()], "path string, content binary"), root, name)
    captures, source, now = spark.read.parquet(root), FileSource("o", "i", "docs"), F.lit("2024-01-01").cast("timestamp")
    before = None
    for name, files in versions.items():
        sync_files(table, captures, source, name, before, now)
        rows = table.read().collect()
        assert {r.source_uri: r.text for r in rows} == {f"{p}.md": t for p, t in files.items()}
        assert len({r.doc_id for r in rows}) == len(rows)
        before = name


def test_runs_count_the_documents_of_their_own_index(spark):
    runs = spark.createDataFrame(
        [("o", "i", 1, None, None, "v2", "v1"), ("o", "j", 2, None, None, "v2", "v1")],
        "owner string, index_name string, run_id int, start_time timestamp, end_time timestamp, checkpoint string, last_checkpoint string",
    )
    index = spark.createDataFrame([("o", "i"), ("o", "j"), ("o", "j")], "owner string, index_name string")
    errors = spark.createDataFrame([], "owner string, seq int, message string")
    assert {r.run_id: r.n_documents for r in close_runs(runs, index, errors, "seq").collect()} == {1: 1, 2: 2}


def test_a_failed_count_is_an_error_and_leaves_the_flag(spark):
    status = spark.createDataFrame([("o", "i", "Auto", "Scheduled", None, 3, True), ("p", "i", "Ignore", "Scheduled", None, 3, True)], STATUS)
    report = drift_report(status, spark.createDataFrame([], "owner string, index_name string"))
    assert {tuple(r) for r in drift_tally(report).collect()} == {("error", 1), ("skipped:policy", 1)}
    flags = spark.createDataFrame([("o", True, None, None)], "owner string, drift_flag boolean, last_detected timestamp, last_remediated timestamp")
    assert {r.owner: r.drift_flag for r in update_drift_flags(flags, report, F.current_timestamp()).collect()} == {"o": True, "p": False}


def test_a_run_leaves_no_scratch_behind(spark):
    import os

    from tidemark.session import cut, scratch_path, scratch_run, shared_dir

    before = set(os.listdir(shared_dir(spark)))
    with scratch_run(spark) as folder:
        assert cut(spark.range(3), "x").count() == 3 and os.listdir(folder)
        inner = scratch_path(spark, "y")
    assert inner.startswith(folder) and set(os.listdir(shared_dir(spark))) == before
    assert not scratch_path(spark, "z").startswith(folder)
