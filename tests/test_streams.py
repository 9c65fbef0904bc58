from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators.documents import url_documents
from tidemark.plans.index_table import IndexTable
from tidemark.session import scratch_path
from tidemark.streaming.feeds import (
    apply_stream,
    carried_flags,
    drift_flags,
    land_counts,
    land_new,
    newest_changes,
    read_stream,
    tick_calendar,
    window_drift,
)

SCHEMA = "id long, owner string, ts timestamp"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def land(spark, folder, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.mode("append").parquet(folder)
    return df.schema


def test_each_key_lands_once_however_late(spark):
    root = scratch_path(spark, "stream")
    schema = land(spark, f"{root}/in", [(1, "a", at(600)), (2, "a", at(601)), (1, "a", at(600)), (None, "a", at(1)), (None, "b", at(1))])

    def run(checkpoint="checkpoint"):
        landed = land_new(read_stream(spark, f"{root}/in", schema, files_per_batch=1), "id", f"{root}/out", f"{root}/{checkpoint}")
        return sorted(r.id for r in landed.where("id IS NOT NULL").collect()), landed.where("id IS NULL").count()

    assert run() == ([1, 2], 2)
    # a replay, and a new row ten hours behind the newest
    land(spark, f"{root}/in", [(2, "a", at(601)), (3, "a", at(2))])
    assert run() == ([1, 2, 3], 2)
    assert run() == ([1, 2, 3], 2)
    # a lost checkpoint reads all again, and what is new
    land(spark, f"{root}/in", [(4, "a", at(3))])
    assert run("other")[0] == [1, 2, 3, 4]


def test_window_counts_take_late_rows_and_lost_checkpoints(spark):
    root = scratch_path(spark, "windows")
    schema = land(spark, f"{root}/in", [(1, "a", at(0)), (2, "a", at(4)), (3, "b", at(900))])

    def run(checkpoint="checkpoint"):
        stream = read_stream(spark, f"{root}/in", schema)
        counts = land_counts(stream, ["owner"], "ts", "5 minutes", f"{root}/out", f"{root}/{checkpoint}")
        return {(r.window_start, r.owner): r.n for r in counts.collect()}

    assert run() == {(at(0), "a"): 2, (at(900), "b"): 1}
    land(spark, f"{root}/in", [(4, "a", at(3)), (5, "a", at(7))])
    after = {(at(0), "a"): 3, (at(900), "b"): 1, (at(5), "a"): 1}
    assert run() == after
    assert run("other") == after


def test_newest_change_per_key(spark):
    batch = spark.createDataFrame([(1, "put", at(0)), (1, "del", at(1)), (2, "del", at(0)), (2, "put", at(0))], SCHEMA)
    got = {(r.id, r.owner) for r in newest_changes(batch, ["id"], ["ts"]).collect()}
    assert got == {(1, "del"), (2, "put")}


def test_flags_follow_the_newest_window(spark):
    counts = spark.createDataFrame(
        [(at(0), at(5), "a", 2), (at(5), at(10), "a", 1), (at(0), at(5), "b", 1), (at(5), at(10), "b", 3), (at(0), at(5), "c", 1)],
        "window_start timestamp, window_end timestamp, owner string, n long",
    )
    expected = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "owner string, expected long")
    got = {tuple(r) for r in drift_flags(window_drift(counts, expected)).collect()}
    assert got == {("a", False, at(5)), ("b", True, at(10)), ("c", False, None)}


def test_changes_are_applied_once_even_when_the_stream_forgets(spark):
    root = scratch_path(spark, "apply")
    index = IndexTable(spark, f"{root}/index")
    schema = land(spark, f"{root}/in", [(1, "put", at(0)), (2, "put", at(0))])

    def to_documents(batch):
        batch = newest_changes(batch, ["id"], ["ts"])
        puts = batch.where("owner = 'put'").select(F.col("id").cast("string").alias("url"), F.lit("t").alias("text"))
        documents = url_documents(puts, index_name="i", owner="o", run_ts=F.lit("2024-01-01").cast("timestamp"))
        gone = batch.where("owner = 'del'").select(F.col("id").cast("string").alias("url"), F.lit("t").alias("text"))
        removed = url_documents(gone, index_name="i", owner="o", run_ts=F.lit("2024-01-01").cast("timestamp"))
        return documents, removed.select("index_name", "doc_id")

    def run(checkpoint):
        apply_stream(read_stream(spark, f"{root}/in", schema), index, f"{root}/{checkpoint}", "feed", to_documents)
        return sorted(r.source_uri for r in index.read().collect())

    assert run("checkpoint") == ["1", "2"]
    land(spark, f"{root}/in", [(1, "del", at(1)), (3, "put", at(1))])
    assert run("checkpoint") == ["2", "3"]
    assert run("checkpoint") == ["2", "3"] and index.commits().count() == 2
    # a lost checkpoint replays everything as batch 0, with a row that is new
    land(spark, f"{root}/in", [(4, "put", at(2))])
    assert run("other-checkpoint") == ["2", "3", "4"]


COUNTS = "window_start timestamp, window_end timestamp, owner string, n long"


def test_silent_sources_drift(spark):
    """Sources that fall silent, that never delivered, and of which nothing is expected; each judged from its first tick on."""
    counts = spark.createDataFrame([(at(0), at(5), "a", 1), (at(5), at(10), "a", 1), (at(15), at(20), "b", 1), (at(0), at(5), "none", 3)], COUNTS)
    expected = spark.createDataFrame([("a", 1), ("b", 1), ("never", 2), ("none", 0)], "owner string, expected long")
    ticks = window_drift(counts, expected, "5 minutes")
    got = {(r.owner, r.window_start, r.n, r.drift) for r in ticks.collect()}
    assert got == {
        ("a", at(0), 1, False), ("a", at(5), 1, False), ("a", at(10), 0, True), ("a", at(15), 0, True), ("b", at(15), 1, False),
        *{("never", at(5 * i), 0, True) for i in range(4)}, *{("none", at(5 * i), 3 if i == 0 else 0, None) for i in range(4)},
    }
    assert {tuple(r) for r in drift_flags(ticks).collect()} == {("a", True, at(20)), ("b", False, None), ("never", True, at(20)), ("none", False, None)}
    # up to the time of the check, and from the time a source is known
    later = {(r.owner, r.window_start) for r in tick_calendar(counts, expected, "5 minutes", until=at(31)).collect()}
    assert max(t for o, t in later if o == "b") == at(30) and min(t for o, t in later if o == "b") == at(15)
    since = expected.withColumn("since", F.when(F.col("owner") == "never", F.lit(at(10))))
    assert {r.window_start for r in tick_calendar(counts, since, "5 minutes").where("owner = 'never'").collect()} == {at(10), at(15)}
    assert tick_calendar(counts.limit(0), expected, "5 minutes").collect() == []
    assert len(tick_calendar(counts.limit(0), expected, "5 minutes", until=at(7)).collect()) == 4


def test_flags_are_carried_over_skipped_checks(spark):
    rows = [("a", at(5), True), ("a", at(10), None), ("a", at(15), False), ("a", at(20), None), ("b", at(5), None)]
    windows = spark.createDataFrame(rows, "owner string, window_end timestamp, drift boolean")
    got = {(r.owner, r.window_end): r.drift_flag for r in carried_flags(windows).collect()}
    assert got == {("a", at(5)): True, ("a", at(10)): True, ("a", at(15)): False, ("a", at(20)): False, ("b", at(5)): False}
    assert {(r.owner, r.drift_flag) for r in drift_flags(windows).collect()} == {("a", False), ("b", False)}
