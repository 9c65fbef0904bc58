from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.changes import (
    append_documents,
    apply_changes,
    changed_files,
    count_documents,
    delete_documents,
    deleted_ids,
    list_documents,
    resolve_doc_ids,
)
from tidemark.operators.diff import change_counts, snapshot_diff, with_hash
from tidemark.operators.documents import file_documents
from tidemark.operators.numbering import batch_numbers, number_rows, progress


def tree(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


def diff(spark, old, new, **kwargs):
    out = snapshot_diff(with_hash(tree(spark, old)), with_hash(tree(spark, new)), **kwargs)
    return {(r.change_type, r.a_path, r.b_path) for r in out.collect()}


def test_every_kind_of_change(spark):
    old = {"keep": "k", "edit": "1", "gone": "g", "from": "moved"}
    new = {"keep": "k", "edit": "2", "new": "n", "to": "moved"}
    assert diff(spark, old, new) == {("M", "edit", "edit"), ("D", "gone", None), ("A", None, "new"), ("R", "from", "to")}


def test_nothing_changed(spark):
    files = {"a": "1", "b": "1", "c": ""}
    assert diff(spark, files, files) == set()


def test_copies_pair_one_to_one(spark):
    old = {f"old{i}": "same" for i in range(5)}
    new = {f"new{i}": "same" for i in range(3)}
    got = diff(spark, old, new)
    kinds = Counter(k for k, _, _ in got)
    assert kinds == {"R": 3, "D": 2}
    assert {a for k, a, _ in got} == set(old) and {b for k, _, b in got if k == "R"} == set(new)


def test_empty_files_never_pair(spark):
    assert diff(spark, {"a": ""}, {"b": ""}) == {("D", "a", None), ("A", None, "b")}


def test_moves_across_the_filter(spark):
    old = {"src/a": "1", "out/b": "2", "src/c": "3"}
    new = {"out/a": "1", "src/b": "2", "src/d": "3"}
    assert diff(spark, old, new, exclude=["out/"]) == {("D", "src/a", None), ("A", None, "src/b"), ("R", "src/c", "src/d")}


def test_renames_stay_inside_a_scope(spark):
    schema = "owner string, path string, content string"
    old = with_hash(spark.createDataFrame([("x", "a", "t"), ("y", "q", "s")], schema))
    new = with_hash(spark.createDataFrame([("y", "b", "t"), ("y", "q2", "s")], schema))
    got = {tuple(r)[:4] for r in snapshot_diff(old, new, scope=["owner"]).collect()}
    assert got == {("x", "D", "a", None), ("y", "A", None, "b"), ("y", "R", "q", "q2")}


def documents(files, change="full"):
    labelled = "change_label" in files.columns
    return file_documents(
        files.withColumnRenamed("content", "text"), index_name="i", owner="o", run_ts=F.lit("2024-01-01").cast("timestamp"),
        change_type=F.col("change_label") if labelled else change, doc_id=F.col("doc_id") if labelled else None,
    )


def random_tree(rng, n):
    return {f"d{rng.randrange(4)}/f{rng.randrange(n)}": rng.choice(["", "a", "b", "c", "long text", "x" * 50]) for _ in range(n)}


@pytest.mark.parametrize("seed", range(3))
def test_applying_the_diff_gives_the_new_index(spark, seed):
    rng = random.Random(seed)
    old, new = random_tree(rng, 40), random_tree(rng, 40)
    for path in list(old)[:15]:
        new[path] = old[path]
    # a file that becomes empty keeps its last document, so leave that case to its own test
    new = {p: t for p, t in new.items() if t or not old.get(p)}
    index = documents(tree(spark, old))
    feed = snapshot_diff(with_hash(tree(spark, old)), with_hash(tree(spark, new)))
    feed = feed.withColumns({"owner": F.lit("o"), "index_name": F.lit("i")})
    resolved = resolve_doc_ids(feed, index)
    upserts = documents(changed_files(tree(spark, new), resolved))
    once = apply_changes(index, upserts, deleted_ids(resolved))
    texts = {(r.source_uri, r.text) for r in once.collect()}
    assert texts == {(p, t) for p, t in new.items() if t}
    twice = apply_changes(once, upserts, deleted_ids(resolved))
    assert sorted(r.doc_id for r in twice.collect()) == sorted(r.doc_id for r in once.collect())
    assert once.count() == once.select("doc_id").distinct().count()


def test_ids_are_carried_and_misses_become_new(spark):
    old = {"edit": "1", "from": "moved", "lost": "old"}
    new = {"edit": "2", "to": "moved", "lost": "new", "add": "a"}
    index = documents(tree(spark, {"edit": "1", "from": "moved", "unrelated": "u"}))
    ids = {r.source_uri: r.doc_id for r in index.collect()}
    feed = snapshot_diff(with_hash(tree(spark, old)), with_hash(tree(spark, new)))
    feed = feed.withColumns({"owner": F.lit("o"), "index_name": F.lit("i")})
    resolved = resolve_doc_ids(feed, index)
    got = {r.b_path: (r.action, r.change_label, r.doc_id) for r in resolved.collect()}
    assert got["edit"] == ("update", "modified", ids["edit"])
    assert got["to"] == ("update", "renamed", ids["from"])
    assert got["lost"][:2] == ("create", "added") and got["add"][:2] == ("create", "added")


def test_deleting_what_the_index_does_not_know(spark):
    feed = spark.createDataFrame(
        [("o", "i", "D", "nowhere", None)], "owner string, index_name string, change_type string, a_path string, b_path string"
    )
    assert resolve_doc_ids(feed, documents(tree(spark, {"a": "1"}))).count() == 0


def test_owners_do_not_see_each_other(spark):
    index = documents(tree(spark, {"a": "1"}))
    feed = spark.createDataFrame(
        [("other", "i", "D", "a", None)], "owner string, index_name string, change_type string, a_path string, b_path string"
    )
    assert resolve_doc_ids(feed, index).count() == 0


def test_emptied_file_keeps_its_last_document(spark):
    index = documents(tree(spark, {"a": "1"}))
    feed = snapshot_diff(with_hash(tree(spark, {"a": "1"})), with_hash(tree(spark, {"a": ""})))
    resolved = resolve_doc_ids(feed.withColumns({"owner": F.lit("o"), "index_name": F.lit("i")}), index)
    upserts = documents(changed_files(tree(spark, {"a": ""}), resolved))
    assert [r.text for r in apply_changes(index, upserts, deleted_ids(resolved)).collect()] == ["1"]


def test_change_counts(spark, rows):
    feed = spark.createDataFrame([("A",), ("A",), ("M",)], "change_type string")
    assert rows(change_counts(feed)) == [("A", 2), ("M", 1)]


def test_listing(spark):
    index = append_documents(documents(tree(spark, {f"f{i}": "t" for i in range(25)})), documents(tree(spark, {"z": "t"}), "added"))
    ids = sorted(r.doc_id for r in index.collect())
    page = list_documents(index, "i", {"owner": "o"}, limit=10, offset=20)
    assert [r.doc_id for r in page.collect()] == ids[20:]
    after = list_documents(index, "i", limit=5, after=ids[9])
    assert [r.doc_id for r in after.collect()] == ids[10:15]
    assert count_documents(index, "i", {"change_type": "added"}) == 1
    assert count_documents(index, "other") == 0
    assert count_documents(index, metadata_filter={"no_such_key": "x"}) == 0
    assert count_documents(index, "i", {"file_path": "z"}) == 1
    assert count_documents(index, "i", {"source_url": "z"}) == 0
    assert delete_documents(index, index.where("source_uri = 'z'")).count() == 25


# ---- numbering ----


def hot(spark, n=6000):
    """A third of all rows share one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    return spark.range(n).select(key.alias("k"), F.col("id").alias("v"))


def test_positions_equal_a_plain_row_number(spark):
    df = hot(spark)
    plain = F.row_number().over(Window.partitionBy("k").orderBy(F.md5(F.col("v").cast("string"))))
    want = {(r.v, r.p) for r in df.select("v", plain.alias("p")).collect()}
    got = {(r.v, r.position) for r in number_rows(df, ["k"], "v").collect()}
    assert got == want


def test_null_keys_are_numbered_too(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    got = sorted((r.k or "", r.position) for r in number_rows(df, ["k"], "v").collect())
    assert got == [("", 1), ("", 2), ("a", 1)]


def test_no_window_holds_all_rows_of_a_key(spark):
    """Rows are only ever windowed by key and slice; by key alone only the slice sizes are."""
    plan = number_rows(hot(spark), ["k"], "v")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2
    for line in windows:
        assert ("row_number" in line and "_slice" in line.split("], [")[1]) or "sum(_size" in line


def test_twelve_rows_make_two_batches_of_ten(spark):
    df = spark.range(12).select(F.lit("o").alias("k"), F.col("id").alias("v"))
    sizes = Counter(r.batch_no for r in batch_numbers(df, "k", "v", 10).collect())
    assert sizes == {0: 10, 1: 2}


def test_progress(spark):
    got = progress(hot(spark, 300), "k", "v").where("k = 'hot'").collect()
    assert sorted(r.done for r in got) == list(range(1, 101)) and {r.total for r in got} == {100}
