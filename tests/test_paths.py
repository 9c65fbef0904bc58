from __future__ import annotations

import os
import random
import shutil
import subprocess

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.paths import LANGUAGES, extension, filter_paths, with_file_type
from tidemark.functions.patterns import RULES, compile_patterns, matches, matches_rules, rule_list


def kept(spark, paths, **kwargs):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r.path for r in filter_paths(df, **kwargs).collect()}


def test_hidden_and_binary_files_are_dropped(spark):
    paths = ["main.py", "src/handler.go", "README.md", ".hidden/file.py", "file.exe", "binary.so", "A.DLL", "a/.b"]
    assert kept(spark, paths) == {"main.py", "src/handler.go", "README.md"}


def test_exclude_directories(spark):
    paths = ["vendor/lib.go", "node_modules/package.js", "src/main.go", "src/vendor", "x/vendor/y.go"]
    assert kept(spark, paths, exclude=["vendor/", "node_modules/"]) == {"src/main.go", "src/vendor"}


def test_exclude_wins_over_include(spark):
    paths = ["docs/a.md", "docs/b.txt", "src/c.md"]
    assert kept(spark, paths, include=["docs/"], exclude=["*.txt"]) == {"docs/a.md"}


def test_patterns_that_say_nothing_select_nothing(spark):
    assert compile_patterns(["", "# note"]) is None
    assert kept(spark, ["a.py"], include=["# only a comment"]) == set()
    assert kept(spark, ["a.py"], exclude=["# only a comment"]) == {"a.py"}


PATHS = [
    "a.py", "b/a.py", "b/c/a.py", "b/c/d/x.txt", "foo", "foo/bar", "foo/bar/baz.go", "x/foo/bar", "x/foo/y",
    "a b.txt", "ab.txt", "abc.txt", "a+b.txt", "docs/readme.md", "docs/sub/readme.md", "x[1].md", "foo.d/z",
    "deep/a/b/c/foo", "vendor/a.go", "vendor/keep/a.go", "k.log", "logs/k.log", "logs/keep.log", "a/b",
]

LISTS = [
    ["*.py"], ["/a.py"], ["b/"], ["b/*.py"], ["**/foo"], ["foo/**"], ["foo"], ["foo/bar"], ["a/**/b"], ["b/**/x.txt"],
    ["?b.txt"], ["[a-b]*.txt"], ["[!a]*.txt"], ["a\\ b.txt"], ["docs/*"], ["docs/**/*.md"], ["*"], ["**"],
    ["*.log", "!keep.log"], ["vendor/", "!vendor/keep/"], ["vendor/*", "!vendor/keep/"], ["/*", "!/docs", "!/foo"],
    ["*.md", "!docs/", "!/docs/*.md"], ["deep/**/foo"], ["**/b/**"], ["a+b.txt"], ["# note", "", "foo/"], ["!foo"],
]


@pytest.mark.skipif(shutil.which("git") is None, reason="needs git as a judge")
def test_patterns_agree_with_git(spark, tmp_path):
    """git itself says which paths an ignore file selects."""
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    columns = [matches(F.col("path"), patterns).alias(f"c{i}") for i, patterns in enumerate(LISTS)]
    got = {r.path: r for r in df.select("path", *columns).collect()}
    for i, patterns in enumerate(LISTS):
        repo = tmp_path / str(i)
        repo.mkdir()
        subprocess.run(["git", "init", "-q", str(repo)], check=True)
        (repo / ".gitignore").write_text("\n".join(patterns) + "\n")
        found = subprocess.run(
            ["git", "-C", str(repo), "-c", "core.quotePath=false", "check-ignore", "--no-index", "--stdin"],
            input="\n".join(PATHS), capture_output=True, text=True, check=False,
        ).stdout.splitlines()
        mine = {p for p in PATHS if got[p][f"c{i}"]}
        assert mine == {p.strip('"') for p in found}, patterns


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab./ \n", min_size=1, max_size=12), min_size=30, max_size=60))
def test_extension_is_splitext(spark, paths):
    paths = [*paths, ".bashrc", "..a", "a.", "a.b.c", "x/.y.z", "...", "a..b"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for row in df.select("path", extension(F.col("path")).alias("ext")).collect():
        assert row.ext == os.path.splitext(row.path)[1], row.path


def test_types_and_languages(spark):
    df = spark.createDataFrame(
        [(p,) for p in ["a.py", "b.go", "c.md", "d.xyz", "E.PY", "Dockerfile", "x/Makefile", "go.mod", ".profile"]],
        "path string",
    )
    got = {r.path: (r.content_type, r.language, r.split_type) for r in with_file_type(df).collect()}
    assert got == {
        "a.py": ("text/x-python", "python", "code"),
        "b.go": ("text/x-go", "go", "code"),
        "c.md": ("text/markdown", "markdown", "code"),
        "d.xyz": ("text/plain", None, None),
        "E.PY": ("text/x-python", "python", "code"),
        "Dockerfile": ("text/plain", "dockerfile", "code"),
        "x/Makefile": ("text/plain", "make", "code"),
        "go.mod": ("text/plain", "gomod", "code"),
        ".profile": ("text/plain", None, None),
    }
    assert len(LANGUAGES) == 72


def test_a_given_content_type_is_kept(spark):
    df = spark.createDataFrame([("a.py", "application/pdf")], "path string, content_type string")
    assert with_file_type(df).first().content_type == "application/pdf"


def test_file_types_are_looked_up_without_a_shuffle(spark):
    df = spark.range(10).select(F.concat(F.col("id").cast("string"), F.lit(".py")).alias("path"))
    plan = with_file_type(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("seed", range(4))
def test_rules_in_a_column_match_like_the_same_list(spark, seed):
    rng = random.Random(seed)
    parts = ["a", "b", "c.md", "d.go", "e"]
    lists = [
        [rng.choice(["!", ""]) + rng.choice(["/", "", "**/", "a/"]) + rng.choice(["*", "a", "b", "*.md", "?.go", "e", "a/**"]) + rng.choice(["/", ""]) for _ in range(5)]
        for _ in range(6)
    ] + [[], ["# comment", ""]]
    paths = sorted({"/".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(80)})
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = spark.createDataFrame([(p, k, rule_list(patterns)) for p in paths for k, patterns in enumerate(lists)], f"path string, k int, rules {RULES}")
    got = {(r.k, r.path) for r in rows.where(matches_rules(F.col("path"), F.col("rules"))).collect()}
    want = {(k, r.path) for k, patterns in enumerate(lists) for r in df.where(matches(F.col("path"), patterns)).collect()}
    assert got == want
