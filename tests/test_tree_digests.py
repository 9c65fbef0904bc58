"""Digests of folders: the same changes as a comparison of all paths, from what differs only."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators.diff import snapshot_diff, with_hash
from tidemark.operators.tree_digests import changed_files_of, differing_folders, folder_digests, folder_of, land_digests, tree_diff
from tidemark.session import scratch_path
from tidemark.sources.trees import land_snapshot


def frame(spark, files):
    return with_hash(spark.createDataFrame(list(files.items()), "path string, content string"))


def rows(df):
    return sorted(map(str, df.select("change_type", "a_path", "b_path", "hash").collect()))


def random_tree(rng, n):
    return {"/".join([f"d{rng.randrange(4)}"] * rng.randrange(4) + [f"e{rng.randrange(5)}", f"f{i}"]): f"text {rng.randrange(n)}" for i in range(n)} | {"top": "t", "a.b/c": "x"}


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_the_comparison_of_all_paths(spark, seed):
    rng, home = random.Random(seed), scratch_path(spark, "digests")
    old = random_tree(rng, 200)
    new = {p: t for p, t in old.items() if rng.random() > 0.05}
    for p in rng.sample(sorted(new), 12):
        new[p] += " edited"
    for p in rng.sample(sorted(new), 8):
        new[f"moved/{p}"] = new.pop(p)
    new["fresh/deep/er/file"] = "new"
    before, after = frame(spark, old), frame(spark, new)
    land_digests(before, home, "v1", buckets=8)
    land_digests(after, home, "v2", buckets=8)
    assert rows(tree_diff(spark, home, "v1", "v2", buckets=8)) == rows(snapshot_diff(before, after))
    rules = {"exclude": ["moved/", "*3"]}
    assert rows(tree_diff(spark, home, "v1", "v2", **rules, buckets=8)) == rows(snapshot_diff(before, after, **rules))
    assert rows(tree_diff(spark, home, "v2", "v2", buckets=8)) == []


def test_only_what_differs_is_read(spark):
    """In a tree of 40 folders one file changes: two levels differ, and the files of one folder are compared."""
    home = scratch_path(spark, "digests")
    old = {f"d{i}/sub/f{k}": f"{i} {k}" for i in range(40) for k in range(25)}
    new = old | {"d7/sub/f3": "changed"}
    for version, files in (("v1", old), ("v2", new)):
        land_digests(frame(spark, files), home, version, buckets=32)
    levels = differing_folders(spark, home, "v1", "v2", buckets=32)
    assert [sorted((r.folder, r.own) for r in level.collect()) for level in levels] == [[("", False)], [("d7", False)], [("d7/sub", True)]]
    sides = changed_files_of(spark, home, "v1", "v2", buckets=32)
    for side in sides:
        assert side.count() == 25
        # files of other buckets are not opened
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
        opened = {re.search(r"bucket=(\d+)", f)[1] for f in side.inputFiles() if "bucket=" in f}
        whole = {re.search(r"bucket=(\d+)", f)[1] for f in spark.read.parquet(f"{home}/files/version=v1").inputFiles()}
        assert len(whole) > 10 and opened <= whole
    assert rows(tree_diff(spark, home, "v1", "v2", buckets=32)) == rows(snapshot_diff(frame(spark, old), frame(spark, new)))


def test_digests_of_folders(spark):
    files = frame(spark, {"a/b/c": "1", "a/d": "2", "e": "3", "a/b/f": "1"})
    got = {r.folder: (r.parent, r.depth, r.n, r.own_n) for r in folder_digests(files).collect()}
    assert got == {"": (None, 0, 4, 1), "a": ("", 1, 3, 1), "a/b": ("a", 2, 2, 2)}
    paths = spark.createDataFrame([("a/b/c",), ("top",), ("",)], "path string")
    assert [r[0] for r in paths.select(folder_of(F.col("path"))).collect()] == ["a/b", "", ""]


def test_swapped_contents_and_paths_show(spark):
    def digest(files):
        return {tuple(r) for r in folder_digests(frame(spark, files)).select("folder", "sum_1", "sum_2").collect()}

    assert digest({"x": "1", "y": "2"}) != digest({"x": "2", "y": "1"})
    assert digest({"x": "1", "y": "1"}) != digest({"x": "1", "z": "1"})


def test_landed_with_a_snapshot(spark):
    home = scratch_path(spark, "digests")
    versions = {"v1": {"a/x": "1", "b/y": "2"}, "v2": {"a/x": "1", "b/z": "2", "c": "3"}, "v3": {}}
    for version, files in versions.items():
        content = spark.createDataFrame([(p, t) for p, t in files.items()], "path string, content string")
        land_snapshot(content, f"{home}/captures", version, digests=f"{home}/digests")
    diff = lambda a, b: {(r.change_type, r.a_path, r.b_path) for r in tree_diff(spark, f"{home}/digests", a, b).collect()}
    assert diff("v1", "v2") == {("R", "b/y", "b/z"), ("A", None, "c")}
    assert diff("v2", "v3") == {("D", p, None) for p in versions["v2"]}
    assert diff("v3", "v1") == {("A", None, p) for p in versions["v1"]}
