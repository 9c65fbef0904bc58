from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators.documents import empty_index, owner_key, row_documents
from tidemark.operators.sinks import send_batches, send_numbered
from tidemark.plans.index_table import IndexTable
from tidemark.plans.sync import FileSource, RowSource, UrlSource, sync_files, sync_rows, sync_urls
from tidemark.session import scratch_path
from tidemark.sources.captures import NO_URLS, capture_error, explode_urls, specs_without_urls
from tidemark.sources.database import choose_query, high_water_mark, run_query
from tidemark.sources.registry import UnknownSourceError, build_source, register_source, union_sources
from tidemark.sources.trees import land_snapshot, read_tree, scan_mode


def test_tree(spark, tmp_path):
    files = {
        "a.py": b"a", "sub/b+c d%.md": b"bb", ".git/config": b"x", "sub/.git/x": b"x", "lib.so": b"x",
        "big.txt": b"x" * 50, "vendor/v.py": b"v", "my.git/ok.txt": b"ok",
    }
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    df = read_tree(spark, str(tmp_path), exclude=["vendor/"], max_size=40)
    got = {r.path: bytes(r.content) for r in df.collect()}
    assert got == {"a.py": b"a", "sub/b+c d%.md": b"bb", "my.git/ok.txt": b"ok"}
    # the other files are dropped while listing, not after reading
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    assert df.inputFiles() is not None
    metrics = spark._jvm.scala.jdk.CollectionConverters.MapHasAsJava(_scan(plan).metrics()).asJava()
    assert metrics.get("numFiles").value() == 3


def _scan(plan):
    if "FileSourceScan" in plan.getClass().getSimpleName():
        return plan
    children = plan.children()
    for i in range(children.size()):
        found = _scan(children.apply(i))
        if found is not None:
            return found
    return None


def test_scan_mode(spark):
    captures = spark.createDataFrame([("v1", "a"), ("v2", "a")], "version string, path string")
    assert scan_mode(captures, None, "v1") == "diff"
    assert scan_mode(captures, None, None) == "full"
    assert scan_mode(captures, None, "") == "full"
    assert scan_mode(captures, None, "lost") == "full"
    assert scan_mode(captures, "v2", "v1") == "full"


def test_url_lists(spark):
    many = spark.createDataFrame([("o", ["a", "b"]), ("p", []), ("q", None)], "owner string, urls array<string>")
    assert [tuple(r) for r in explode_urls(many).collect()] == [("o", "a"), ("o", "b")]
    assert {(r.owner, r.message) for r in specs_without_urls(many).collect()} == {("p", NO_URLS), ("q", NO_URLS)}
    bare = spark.createDataFrame([("o", "a")], "owner string, urls string")
    assert [tuple(r) for r in explode_urls(bare).collect()] == [("o", "a")]


@pytest.mark.parametrize(
    "url, size, declared, message",
    [
        ("https://a.b/c", 10, None, None),
        ("https://a.b/c", 5, 10, "File too large: 10 bytes exceeds limit of 6 bytes"),
        ("https://a.b/c", 7, 6, "File too large: exceeds limit of 6 bytes"),
        ("https://a.b/c", 6, 6, None),
        ("nope", 7, None, "Invalid URL format: nope"),
    ],
)
def test_capture_errors(spark, url, size, declared, message):
    df = spark.createDataFrame([(url, bytearray(b"x" * size), declared)], "url string, content binary, declared long")
    limit = 100 if size == 10 and declared is None else 6
    got = df.select(capture_error(F.col("url"), F.col("content"), limit, F.col("declared")).alias("e")).first().e
    assert got == message


def test_choice_of_query():
    t = dt.datetime(2024, 1, 1)
    assert choose_query("first", "next", None) == "first"
    assert choose_query("first", None, t) == "first"
    assert choose_query("first", "x > $LAST_INDEXING_TIMESTAMP", t) == "x > :last_ts"
    assert choose_query("first", "x > '$LAST_INDEXING_TIMESTAMP'", t) == "x > :last_ts"


def test_incremental_query_and_high_water_mark(spark):
    times = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, ts timestamp").createOrReplaceTempView("src_rows")
    first = run_query(spark, "select * from src_rows", "select * from src_rows where ts > $LAST_INDEXING_TIMESTAMP", None)
    assert first.count() == 3
    mark = high_water_mark(first.where("id < 2"))
    assert mark == times[1]
    later = run_query(spark, "select * from src_rows", "select * from src_rows where ts > $LAST_INDEXING_TIMESTAMP", mark)
    assert [r.id for r in later.collect()] == [2]
    assert high_water_mark(later.where("false")) is None


def test_dispatch(spark):
    register_source("Git", lambda s, spec: s.range(spec["n"]).select(F.lit("x").alias("owner")))
    assert build_source(spark, {"type": "gIT", "n": 3}).count() == 3
    with pytest.raises(UnknownSourceError):
        build_source(spark, {"type": "Ftp"})
    with pytest.raises(UnknownSourceError):
        build_source(spark, {})
    both = union_sources([spark.sql("select 1 a, 2 b"), spark.sql("select 3 a, 4 c")])
    assert {tuple(r) for r in both.collect()} == {(1, 2, None), (3, None, 4)}
    assert empty_index(spark).count() == 0


def test_batches_are_small_and_a_failure_does_not_stop_the_rest(spark):
    def send(rows):
        assert len(rows) <= 10
        if any(r["doc_id"] == 25 for r in rows):
            raise RuntimeError("service said no")

    df = spark.range(0, 47, 1, 1).select(F.col("id").alias("doc_id"))
    got = sorted(send_batches(df, send, 10).collect(), key=lambda r: r.batch)
    assert [r.n_rows for r in got] == [10, 10, 10, 10, 7]
    assert [r.error for r in got] == [None, None, "Failed to index document batch: service said no", None, None]


def captures(spark, versions):
    data = [(v, p, bytearray(c)) for v, files in versions.items() for p, c in files.items()]
    return spark.createDataFrame(data, "version string, path string, content binary")


def test_documents_reach_the_client_with_their_metadata(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")

    def send(batch):
        for row in batch:
            assert dict(row["metadata"])["owner"] == "o" and row["text"] in "ab" and row["language"] is None, row

    documents = row_documents(rows, key="id", index_name="i", owner="o", run_ts=now)
    assert {r.error for r in send_batches(documents, send, 10).collect()} == {None}


SOURCE = FileSource("ns_docs", "i", "repo", exclude=("secret/",))
V1 = {"a.py": b"print(1)", "b.md": b"two", "c.txt": b"three", "secret/x": b"s", "bin.exe": b"MZ", "m.txt": b"move me"}
V2 = {"a.py": b"print(2)", "c.txt": b"three", "d.md": b"d\xe9", "new/m.txt": b"move me", "e.dat": b"\x00\x01", "secret/b.md": b"two"}


def state(table):
    return {r.source_uri: (r.text, r.change_type, r.language, r.doc_id) for r in table.read().collect()}


def test_full_then_incremental(spark):
    table = IndexTable(spark, scratch_path(spark, "index"))
    data, now = captures(spark, {"v1": V1, "v2": V2}), F.lit("2024-01-01").cast("timestamp")
    planned = sync_files(table, data, SOURCE, "v1", None, now, plan_only=True)
    assert {r.b_path for r in planned.collect()} == {"a.py", "b.md", "c.txt", "m.txt"} and table.read().count() == 0
    sync_files(table, data, SOURCE, "v1", None, now)
    first = state(table)
    assert {k: v[:3] for k, v in first.items()} == {
        "a.py": ("print(1)", "full", "python"), "b.md": ("two", "full", "markdown"), "c.txt": ("three", "full", None),
        "m.txt": ("move me", "full", None),
    }
    planned = sync_files(table, data, SOURCE, "v2", "v1", now, plan_only=True)
    assert {(r.change_type, r.a_path, r.b_path, r.action) for r in planned.collect()} == {
        ("M", "a.py", "a.py", "update"), ("D", "b.md", None, "delete"), ("A", None, "d.md", "create"),
        ("R", "m.txt", "new/m.txt", "update"), ("A", None, "e.dat", "create"),
    }
    assert state(table) == first
    sync_files(table, data, SOURCE, "v2", "v1", now)
    second = state(table)
    assert {k: v[:3] for k, v in second.items()} == {
        "a.py": ("print(2)", "modified", "python"), "c.txt": ("three", "full", None), "d.md": ("dé", "added", "markdown"),
        "new/m.txt": ("move me", "renamed", None), "e.dat": ("\x00\x01", "added", None),
    }
    assert second["a.py"][3] == first["a.py"][3] and second["new/m.txt"][3] == first["m.txt"][3]
    # once more changes nothing
    sync_files(table, data, SOURCE, "v2", "v1", now)
    assert {k: v[0] for k, v in state(table).items()} == {k: v[0] for k, v in second.items()}
    # incremental equals full
    fresh = IndexTable(spark, scratch_path(spark, "index"))
    sync_files(fresh, data, SOURCE, "v2", "lost", now)
    assert {k: v[0] for k, v in state(fresh).items()} == {k: v[0] for k, v in second.items()}


def test_unreadable_files_give_error_rows_and_hold_the_checkpoint(spark):
    from tidemark.plans.sync_all import sync_all

    now = F.lit("2024-01-01").cast("timestamp")
    data = spark.createDataFrame(
        [(v, o, "ok.md", bytearray(v.encode()), "text/plain") for v in ("v1", "v2") for o in "ab"]
        + [("v2", "a", "bad", bytearray(b"\x00"), "application/octet-stream"), ("v2", "b", "bad", bytearray(b"%PDF"), None)],
        "version string, owner string, path string, content binary, content_type string",
    )
    schema = (
        "owner string, index_name string, repository string, branch string, version string, checkpoint string,"
        " include_re string, exclude_re string"
    )
    specs = spark.createDataFrame([(o, "i", "r", "m", "v2", c, None, None) for o, c in (("a", "v1"), ("b", None))], schema)
    table = IndexTable(spark, scratch_path(spark, "index"))
    done, errors = sync_all(table, data, specs, now)
    assert {tuple(r) for r in done.collect()} == {("a", False, "v1", 1), ("b", True, None, 1)}
    expected = {("bad", "No suitable content handler found"), ("bad", "No text extractor for handler pdf")}
    assert {(r.unit, r.message) for r in errors.collect()} == expected
    assert {(r.owner, r.source_uri, r.text) for r in table.read().collect()} == {("a", "ok.md", "v2"), ("b", "ok.md", "v2")}
    single = IndexTable(spark, scratch_path(spark, "index"))
    mine = data.where("owner = 'a'").drop("owner")
    assert sync_files(single, mine, FileSource("a", "i", "r"), "v1", None, now).count() == 0
    failed = sync_files(single, mine, FileSource("a", "i", "r"), "v2", "v1", now)
    assert [tuple(r) for r in failed.collect()] == [("a", "bad", "No suitable content handler found")]


def test_owners_may_land_the_same_version(spark):
    root = scratch_path(spark, "captures")
    for owner, text in (("a", b"1"), ("b", b"2"), ("a", b"3")):
        land_snapshot(spark.createDataFrame([(owner, "x.md", text)], "owner string, path string, content binary"), root, "v1")
    got = {(r.owner, r.version, bytes(r.content)) for r in spark.read.parquet(root).collect()}
    assert got == {("a", "v1", b"3"), ("b", "v1", b"2")}


def test_declared_charsets_repeated_captures_and_declared_lengths(spark):
    text, now = "Привет", F.lit("2024-01-01").cast("timestamp")
    table = IndexTable(spark, scratch_path(spark, "index"))
    rows = [
        ("https://a.b/1", bytearray(text.encode("cp1251")), "text/plain; charset=windows-1251", 6, dt.datetime(2024, 1, 1)),
        ("https://a.b/2", bytearray(text.encode("utf-16")), "text/plain; charset=UTF-16", None, dt.datetime(2024, 1, 1)),
        ("https://a.b/3", bytearray(b"new"), "text/plain", None, dt.datetime(2024, 1, 3)),
        ("https://a.b/3", bytearray(b"old"), "text/plain", None, dt.datetime(2024, 1, 2)),
        ("https://a.b/4", bytearray(b"cut"), "text/plain", 99, dt.datetime(2024, 1, 1)),
    ]
    data = spark.createDataFrame(rows, "url string, content binary, content_type string, content_length long, at timestamp")
    errors = sync_urls(table, data, UrlSource("o", "i", max_size=40, ts="at"), now)
    assert {r.source_uri[-1]: r.text for r in table.read().collect()} == {"1": text, "2": text, "3": "new"}
    assert [(r.unit[-1], r.message) for r in errors.collect()] == [("4", "File too large: 99 bytes exceeds limit of 40 bytes")]


def test_failfast_run_writes_nothing(spark):
    table = IndexTable(spark, scratch_path(spark, "index"))
    strict = FileSource("o", "i", "repo", mode="failfast")
    data = spark.createDataFrame(
        [("v1", "ok.md", bytearray(b"x"), "text/plain"), ("v1", "bad", bytearray(b"\x00"), "application/octet-stream")],
        "version string, path string, content binary, content_type string",
    )
    with pytest.raises(PySparkException):
        sync_files(table, data, strict, "v1", None, F.lit("2024-01-01").cast("timestamp"))
    assert table.read().count() == 0


def test_owner_key(spark):
    row = spark.range(1).select(owner_key(F.lit("team"), F.lit("docs")).alias("v")).first()
    assert row.v == "team_docs"


def test_keyed_rows_upsert(spark):
    table = IndexTable(spark, scratch_path(spark, "index"))
    now = F.lit("2024-01-01").cast("timestamp")
    for text in ("first", "second"):
        rows = spark.createDataFrame([(7, text)], "id int, text string")
        table.index_documents(row_documents(rows, key="id", index_name="i", owner="o", run_ts=now))
    assert [r.text for r in table.read().collect()] == ["second"]


def test_a_full_run_takes_the_place_of_the_one_before(spark):
    table = IndexTable(spark, scratch_path(spark, "index"))
    data, now = captures(spark, {"v1": V1, "v2": V2}), F.lit("2024-01-01").cast("timestamp")
    other = FileSource("ns_other", "i", "repo")
    sync_files(table, data, other, "v1", None, now)
    sync_files(table, data, SOURCE, "v1", None, now)
    sync_files(table, data, SOURCE, "v2", "v1", now, pinned=True)
    mine = {r.source_uri for r in table.read().where("owner = 'ns_docs'").collect()}
    assert mine == {"a.py", "c.txt", "d.md", "new/m.txt", "e.dat"}
    theirs = {r.source_uri for r in table.read().where("owner = 'ns_other'").collect()}
    assert theirs == {"a.py", "b.md", "c.txt", "m.txt", "secret/x"}


def test_landed_snapshots_are_compared_without_reading_content(spark):
    from tidemark.operators.diff import snapshot_diff, with_hash

    root = scratch_path(spark, "captures")
    for version, files in (("v1", V1), ("v2", V2)):
        land_snapshot(captures(spark, {version: files}).drop("version"), root, version)
    data = spark.read.parquet(root)
    feed = snapshot_diff(with_hash(data.where("version = 'v1'")), with_hash(data.where("version = 'v2'")), cut=False)
    assert {(r.change_type, r.a_path, r.b_path) for r in feed.collect()} >= {("M", "a.py", "a.py"), ("R", "m.txt", "new/m.txt")}
    plan = feed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "version" in plan
    table = IndexTable(spark, scratch_path(spark, "index"))
    now = F.lit("2024-01-01").cast("timestamp")
    sync_files(table, data, SOURCE, "v1", None, now)
    sync_files(table, data, SOURCE, "v2", "v1", now)
    assert {r.source_uri for r in table.read().collect()} == {"a.py", "c.txt", "d.md", "new/m.txt", "e.dat"}


def test_url_run(spark):
    table = IndexTable(spark, scratch_path(spark, "index"))
    now = F.lit("2024-01-01").cast("timestamp")
    schema = "url string, content binary, content_type string"
    data = spark.createDataFrame(
        [("https://a.b/x.py", bytearray(b"print"), "text/plain"), ("nope", bytearray(b"x"), "text/plain"),
         ("https://a.b/big", bytearray(b"x" * 50), "text/plain"), ("https://a.b/bin", bytearray(b"\x00"), "image/png"),
         ("https://a.b/empty", bytearray(b""), "text/plain")],
        schema,
    )
    errors = sync_urls(table, data, UrlSource("o", "i", max_size=40), now)
    assert {(r.unit, r.message) for r in errors.collect()} == {
        ("nope", "Invalid URL format: nope"), ("https://a.b/big", "File too large: exceeds limit of 40 bytes"),
        ("https://a.b/bin", "No suitable content handler found"),
    }
    assert {r.source_uri: (r.text, r.language) for r in table.read().collect()} == {"https://a.b/x.py": ("print", "python")}
    again = spark.createDataFrame([("https://a.b/x.py", bytearray(b"new"), "text/plain")], schema)
    sync_urls(table, again, UrlSource("o", "i"), now)
    assert [r.text for r in table.read().collect()] == ["new"]
    with pytest.raises(PySparkException):
        sync_urls(table, data, UrlSource("o", "i", mode="failfast"), now)
    assert [r.text for r in table.read().collect()] == ["new"]


def test_row_runs(spark):
    table = IndexTable(spark, scratch_path(spark, "index"))
    now = F.lit("2024-01-01").cast("timestamp")
    times = [dt.datetime(2024, 1, d) for d in (1, 2, 2)]

    def source(key):
        return RowSource(
            "o", "i", "select * from run_rows", "select * from run_rows where ts > $LAST_INDEXING_TIMESTAMP", key, "ts"
        )

    spark.createDataFrame([(1, t) for t in times], "id int, ts timestamp").createOrReplaceTempView("run_rows")
    mark = sync_rows(spark, table, source(None), None, now, "r1")
    assert mark == times[1] and table.read().count() == 3  # equal rows are all kept
    assert sync_rows(spark, table, source(None), mark, now, "r2") == mark and table.read().count() == 3
    spark.createDataFrame([(1, dt.datetime(2024, 1, 5)), (2, dt.datetime(2024, 1, 4))], "id int, ts timestamp").createOrReplaceTempView("run_rows")
    mark = sync_rows(spark, table, source("id"), mark, now, "r3")
    assert mark == dt.datetime(2024, 1, 5) and table.read().count() == 5
    sync_rows(spark, table, source("id"), None, now, "r4")
    assert table.read().count() == 5


def test_one_job_for_all_sources(spark):
    from tidemark.plans.sync_all import path_rules, sync_all

    root, now = scratch_path(spark, "captures"), F.lit("2024-01-01").cast("timestamp")
    for owner, versions in {"a": ("v1", "v2"), "b": ("v1", "v2"), "c": ("v2",)}.items():
        for version in versions:
            files = captures(spark, {version: V1 if version == "v1" else V2}).select(F.lit(owner).alias("owner"), "path", "content")
            land_snapshot(files, root, version)
    data = spark.read.parquet(root)
    include, exclude = path_rules(["*.md", "*.txt", "*.py"], ["secret/"])
    schema = (
        "owner string, index_name string, repository string, branch string, version string, checkpoint string,"
        " include_re string, exclude_re string"
    )

    def specs(*rows):
        return spark.createDataFrame([(o, "i", "r", "main", v, c, i, e) for o, v, c, i, e in rows], schema)

    table = IndexTable(spark, scratch_path(spark, "index"))
    done, errors = sync_all(table, data, specs(("a", "v1", None, include, exclude), ("b", "v1", "never", None, None)), now)
    assert {tuple(r) for r in done.collect()} == {("a", True, "v1", 0), ("b", True, "v1", 0)} and errors.count() == 0

    def paths(owner):
        return {r.source_uri: r.change_type for r in table.read().where(F.col("owner") == owner).collect()}

    assert paths("a") == dict.fromkeys(["a.py", "b.md", "c.txt", "m.txt"], "full")
    assert paths("b") == dict.fromkeys(["a.py", "b.md", "c.txt", "m.txt", "secret/x"], "full")
    done, errors = sync_all(
        table, data,
        specs(("a", "v2", "v1", include, exclude), ("b", "v2", "gone", None, exclude), ("c", "v2", None, include, None)), now,
    )
    assert {tuple(r) for r in done.collect()} == {("a", False, "v2", 0), ("b", True, "v2", 0), ("c", True, "v2", 0)}
    assert errors.count() == 0
    assert paths("a") == {"a.py": "modified", "c.txt": "full", "d.md": "added", "new/m.txt": "renamed"}
    assert paths("b") == dict.fromkeys(["a.py", "c.txt", "d.md", "new/m.txt", "e.dat"], "full")
    assert paths("c") == dict.fromkeys(["a.py", "c.txt", "d.md", "new/m.txt", "secret/b.md"], "full")
    assert path_rules(["# nothing"], ["# nothing"]) == ("(?!)", None)
    with pytest.raises(ValueError):
        path_rules(["!a"])


def test_numbered_lists_are_the_same_on_every_run(spark):
    """Lists of 10 and of 50 with a remainder; a bad list fails alone; another partitioning sends the same lists."""
    rows = [(f"d{i}", "hot" if i % 3 else f"s{i % 2}", "x", i) for i in range(137)]
    df = spark.createDataFrame(rows, "doc_id string, source string, text string, batch int")

    def deliver(batch):
        assert set(batch[0]) == {"doc_id", "source", "text", "batch"}
        if any(r["doc_id"] == "d7" for r in batch):
            raise ValueError("refused")

    def lists(frame, size):
        sent = send_numbered(frame, deliver, size, ["source"], "doc_id")
        return sorted((r.source, r.batch_no, r.n_rows, r.first_unit, r.error) for r in sent.collect())

    for size in (10, 50):
        got = lists(df.repartition(7), size)
        assert got == lists(df.coalesce(1), size)
        for source in ("hot", "s0", "s1"):
            total = sum(s == source for _, s, _, _ in rows)
            sizes = [n for s, _, n, _, _ in got if s == source]
            assert sizes == [size] * (total // size) + ([total % size] if total % size else [])
        assert [e for *_, e in got if e] == ["Failed to index document batch: refused"]
    assert send_numbered(df.limit(0), deliver, 10, ["source"], "doc_id").collect() == []
    two = send_numbered(df, deliver, 10, ["source", "text"], "doc_id")
    assert sum(r.n_rows for r in two.collect()) == 137
