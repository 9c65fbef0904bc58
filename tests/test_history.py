from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.conditions import condition_history, in_ranges, latest_conditions, merge_status, patch_status
from tidemark.operators.runs import (
    completion_events,
    error_summary,
    registry_runs,
    retain_runs,
    run_counts,
    run_totals,
)

from tidemark.operators.status import close_runs, run_conditions, runnable

RUNS = "owner string, run_id long, start_time timestamp, end_time timestamp, active int, failed int, succeeded int"
T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def runs(spark, rows):
    """(owner, minute, kind) per run; kind is a, f, s or - for none."""
    data = [
        (o, i, at(m), at(m + 2), int("a" in k), int("f" in k), int("s" in k)) for i, (o, m, k) in enumerate(rows)
    ]
    return spark.createDataFrame(data, RUNS)


def test_counts_by_precedence(spark):
    df = runs(spark, [("x", 1, "a"), ("x", 2, "f"), ("x", 3, "s"), ("x", 4, "af"), ("x", 5, "fs"), ("x", 6, "-")])
    row = run_counts(df).first()
    assert (row.running, row.failed, row.completed) == (2, 2, 1)


@pytest.mark.parametrize(
    "history, failed",
    [
        ([(1, "f")], True),
        ([(1, "f"), (2, "s")], False),
        ([(2, "f"), (1, "s")], True),
        ([(1, "f"), (2, "a")], False),
        ([(1, "f"), (2, "-")], True),
        ([(1, "-")], False),
        ([(1, "s"), (1, "f")], True),
    ],
)
def test_did_the_latest_run_fail(spark, history, failed):
    df = runs(spark, [("x", m, k) for m, k in history])
    assert run_counts(df).first().latest_failed is failed


def test_sources_without_runs_count_zero(spark):
    registry = spark.createDataFrame([("x",), ("y",)], "owner string")
    got = {r.owner: (r.running, r.failed, r.completed, r.latest_failed) for r in registry_runs(registry, runs(spark, [("x", 1, "f"), ("z", 1, "s")])).collect()}
    assert got == {"x": (0, 1, 0, True), "y": (0, 0, 0, False)}


def test_totals(spark):
    got = {r.owner: r for r in run_totals(runs(spark, [("x", 1, "s"), ("x", 2, "f"), ("y", 1, "s"), ("y", 2, "a")])).collect()}
    assert got["x"].done and got["x"].any_failed and not got["y"].done and not got["y"].any_failed
    assert got["x"].max_seconds == 120 and got["x"].total_seconds == 240


def test_retention(spark):
    df = runs(spark, [("x", m, "s") for m in range(6)] + [("x", m, "f") for m in range(3)] + [("x", 9, "a"), ("x", 10, "-")])
    kept = {r.run_id for r in retain_runs(df).collect()}
    assert kept == {3, 4, 5, 8, 9, 10}


def test_retention_is_limited_before_the_shuffle(spark):
    plan = retain_runs(runs(spark, [("x", 1, "s")]))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_error_summary(spark):
    errors = spark.createDataFrame(
        [("x", i, f"e{i}") for i in range(5)] + [("y", 1, "only")] + [("z", i, f"z{i}") for i in range(3)],
        "owner string, seq int, message string",
    )
    got = {r.owner: (r.n_errors, r.summary) for r in error_summary(errors, "seq").collect()}
    assert got == {"x": (5, "e0; e1; e2 (and 2 more)"), "y": (1, "only"), "z": (3, "z0; z1; z2")}


def test_closing_events(spark):
    done = spark.createDataFrame([("x", 7, 3), ("y", 2, 9)], "owner string, n_documents int, seconds int")
    errors = spark.createDataFrame([("y", 1, "boom")], "owner string, seq int, message string")
    got = {r.owner: (r.reason, r.event_type, r.message) for r in completion_events(done, errors, "seq").collect()}
    assert got["x"] == ("IndexingCompleted", "Normal", "Job completed successfully. Processed 7 documents in 3 seconds.")
    assert got["y"] == (
        "IndexingFailed", "Warning", "Job failed after 9 seconds. Documents indexed: 2. Errors: boom",
    )


CONDITIONS = "owner string, type string, status boolean, ts timestamp, event_id long"


@pytest.mark.parametrize("chunk", [60, 600, 86400, None])
def test_transitions_by_brute_force(spark, chunk):
    rng = random.Random(chunk)
    events = [
        (rng.choice("xxxy"), rng.choice("tu"), rng.choice([True, False, False, None]), at(rng.randrange(200)), i)
        for i in range(400)
    ]
    want, state = {}, {}
    for o, t, s, ts, i in sorted(events, key=lambda e: (e[3], e[4])):
        if (o, t) not in state or state[o, t][0] != s:
            state[o, t] = (s, ts)
        want[i] = state[o, t][1]
    df = spark.createDataFrame(events, CONDITIONS)
    got = {r.event_id: r.last_transition for r in condition_history(df, chunk_seconds=chunk).collect()}
    assert got == want
    newest = {(r.owner, r.type): r.event_id for r in latest_conditions(df).collect()}
    assert newest == {
        k: max((e[3], e[4]) for e in events if (e[0], e[1]) == k)[1] for k in {(e[0], e[1]) for e in events}
    }


def test_status_fields_fold_and_patch(spark):
    updates = spark.createDataFrame(
        [("x", at(1), 1, "a", 5), ("x", at(2), 2, None, 6), ("x", at(3), 3, "c", None), ("y", at(1), 4, None, None)],
        "owner string, ts timestamp, event_id long, phase string, n int",
    )
    merged = merge_status(updates, ["phase", "n"])
    assert {tuple(r) for r in merged.collect()} == {("x", "c", 6), ("y", None, None)}
    patch = spark.createDataFrame([("x", None, 9), ("z", "new", None)], "owner string, phase string, n int")
    assert {tuple(r) for r in patch_status(merged, patch, ["phase", "n"]).collect()} == {
        ("x", "c", 9), ("y", None, None), ("z", "new", None)
    }


def test_a_hot_condition_is_windowed_in_chunks(spark):
    df = spark.range(100).select(
        F.lit("x").alias("owner"), F.lit("t").alias("type"), (F.col("id") % 2 == 0).alias("status"),
        F.timestamp_seconds("id").alias("ts"), F.col("id").alias("event_id"),
    )
    for chunked in (condition_history(df), condition_history(df, chunk_seconds=7)):
        assert chunked.count() == 100
        plan = chunked._jdf.queryExecution().optimizedPlan().toString()
        by_rows = [line for line in plan.splitlines() if "Window [" in line and "ts#" in line.split("], [")[-1]]
        assert by_rows and all("_chunk" in line for line in by_rows)


def test_events_without_owner_type_or_time_stay(spark):
    rows = [(None, "t", True, at(1), 1), ("x", None, True, at(2), 2), ("x", "t", True, None, 3), ("x", "t", False, at(5), 4), ("x", "t", False, at(90000), 5)]
    df = spark.createDataFrame(rows, CONDITIONS)
    got = {r.event_id: r.last_transition for r in condition_history(df).collect()}
    assert got == {1: at(1), 2: at(2), 3: None, 4: at(5), 5: at(5)}


def test_closing_a_run(spark):
    ended = spark.createDataFrame(
        [("x", 1, at(0), at(2), "v2", "v1"), ("y", 2, at(0), at(1), "v2", "v1"), ("z", 3, at(0), at(0), "v2", None)],
        "owner string, run_id int, start_time timestamp, end_time timestamp, checkpoint string, last_checkpoint string",
    )
    index = spark.createDataFrame([("x",), ("x",), ("y",)], "owner string")
    errors = spark.createDataFrame([("y", 1, "boom"), ("z", 1, "bang")], "owner string, seq int, message string")
    closed = close_runs(ended, index, errors, "seq")
    got = {r.owner: (r.seconds, r.n_documents, r.n_errors, r.succeeded, r.checkpoint) for r in closed.collect()}
    assert got == {"x": (120, 2, 0, True, "v2"), "y": (60, 1, 1, False, "v1"), "z": (0, 0, 1, False, None)}
    events = {(r.owner, r.type): (r.status, r.reason, r.message) for r in run_conditions(closed).collect()}
    assert events["x", "Succeeded"] == (True, "IndexingCompleted", "Indexing completed successfully")
    assert events["x", "Error"] == (False, "IndexingCompleted", "No errors during indexing")
    assert events["y", "Error"] == (True, "IndexingErrors", "Indexing completed with errors: boom")
    assert events["y", "Succeeded"][0] is False and len(events) == 12


def test_runnable(spark):
    registry = spark.createDataFrame([("a", None), ("b", True), ("c", False)], "owner string, suspend boolean")
    active = spark.createDataFrame([("c", 1), ("a", 0)], "owner string, active int")
    assert {r.owner for r in runnable(registry, active).collect()} == {"a"}


def test_a_burst_of_one_condition_is_many_even_ranges(spark):
    """All events of one condition within a day: no piece is twice the median, and the history is that of one sorted pass."""
    events = spark.range(5000).select(
        F.lit("x").alias("owner"), F.lit("t").alias("type"), (F.col("id") % 7 < 3).alias("status"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 17 % 80_000).alias("ts"), F.col("id").alias("event_id"),
    )
    pieces = in_ranges(events, ["owner", "type", "ts", "event_id"], 16)
    sizes = sorted(r["count"] for r in pieces.groupBy("_chunk").count().collect())
    assert len(sizes) == 16 and sizes[-1] < 2 * sizes[8]
    state, want = None, {}
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.event_id)):
        if state is None or state[0] != r.status:
            state = (r.status, r.ts)
        want[r.event_id] = state[1]
    assert {r.event_id: r.last_transition for r in condition_history(events, ranges=16).collect()} == want
    assert {r.event_id: r.last_transition for r in condition_history(events, ranges=1).collect()} == want
