"""Runs, errors, conditions and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import iso_utc
from ..operators.conditions import condition_history, latest_conditions, latest_rows, merge_status
from ..operators.runs import completion_events, outcome, retain_runs
from ..operators.runs import run_totals as total_runs
from ..operators.runs import error_summary as summarize_errors
from ..operators.runs import registry_runs
from ..operators.status import close_runs, runnable
from ..operators.status import run_conditions as conditions_of
from .inputs import (
    OWNER,
    REGISTRY_SQL,
    RUNS_SQL,
    conditions,
    index_of,
    new_tree,
    registry,
    run_ts,
    runs,
    table,
)
from .registry import query


@query(f"""
WITH {RUNS_SQL}, {REGISTRY_SQL},
counted AS (
  SELECT owner, count(*) FILTER (outcome = 'running') AS running, count(*) FILTER (outcome = 'failed') AS failed,
         count(*) FILTER (outcome = 'completed') AS completed,
         arg_max(outcome, start_time) FILTER (outcome IS NOT NULL) = 'failed' AS latest_failed
  FROM runs GROUP BY owner)
SELECT r.owner, coalesce(running, 0) AS running, coalesce(failed, 0) AS failed,
       coalesce(completed, 0) AS completed, coalesce(latest_failed, false) AS latest_failed
FROM registry r LEFT JOIN counted c ON r.owner = c.owner
""")
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = registry_runs(registry(spark, sf_dir), runs(spark, sf_dir))
    return joined.select("owner", "running", "failed", "completed", "latest_failed")


@query(f"""
WITH {RUNS_SQL}
SELECT owner, count(*) FILTER (outcome = 'completed') AS success_count,
  count(*) FILTER (outcome = 'failed') AS error_count,
  max(seconds) AS max_seconds, CAST(sum(seconds) AS BIGINT) AS total_seconds,
  bool_or(coalesce(outcome = 'completed', false)) AND NOT bool_or(coalesce(outcome = 'running', false)) AS done,
  bool_or(coalesce(outcome = 'failed', false)) AS any_failed
FROM runs GROUP BY owner
""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return total_runs(runs(spark, sf_dir))


@query(f"""
WITH {RUNS_SQL}
SELECT owner, run_id, outcome FROM (
  SELECT *, row_number() OVER (PARTITION BY owner, outcome ORDER BY start_time DESC, run_id DESC) AS k FROM runs)
WHERE (outcome = 'completed' AND k <= 3) OR (outcome = 'failed' AND k <= 1) OR outcome = 'running' OR outcome IS NULL
""")
def run_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retain_runs(runs(spark, sf_dir)).select("owner", "run_id", "outcome")


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message per event, so every owner has many."""
    return table(spark, sf_dir, "events").selectExpr(
        f"{OWNER} AS owner", "event_id", "'Failed to fetch ' || event_type || ' ' || event_id AS message"
    )


ERRORS_SQL = f"""
errors AS (SELECT {OWNER} AS owner, event_id, 'Failed to fetch ' || event_type || ' ' || event_id AS message FROM events),
summed AS (
  SELECT owner, count(*) AS n_errors,
    array_to_string(list_slice(list(message ORDER BY event_id), 1, 3), '; ')
      || CASE WHEN count(*) > 3 THEN ' (and ' || (count(*) - 3) || ' more)' ELSE '' END AS summary
  FROM errors GROUP BY owner)
"""


@query(f"WITH {ERRORS_SQL} SELECT owner, n_errors, summary FROM summed")
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize_errors(_errors(spark, sf_dir), "event_id").select("owner", "n_errors", "summary")


@query(f"""
WITH {ERRORS_SQL}, {REGISTRY_SQL}
SELECT r.owner, CASE WHEN n_errors > 0 THEN 'IndexingFailed' ELSE 'IndexingCompleted' END AS reason,
  CASE WHEN n_errors > 0 THEN 'Warning' ELSE 'Normal' END AS event_type,
  CASE WHEN n_errors > 0
    THEN 'Job failed after ' || length(r.name) || ' seconds. Documents indexed: ' || length(r.engine) || '. Errors: ' || summary
    ELSE 'Job completed successfully. Processed ' || length(r.engine) || ' documents in ' || length(r.name) || ' seconds.'
  END AS message
FROM registry r LEFT JOIN summed s ON r.owner = s.owner
""")
def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closing event of every source's run."""
    closed = registry(spark, sf_dir).select(
        "owner", F.length("engine").alias("n_documents"), F.length("name").alias("seconds")
    )
    return completion_events(closed, _errors(spark, sf_dir), "event_id")


CONDITIONS_SQL = f"""
conditions AS (SELECT {OWNER} AS owner, event_type AS type, value >= 20 AS status, ts, event_id FROM events),
marked AS (
  SELECT *, lag(status) OVER (PARTITION BY owner, type ORDER BY ts, event_id) AS before FROM conditions),
history AS (
  SELECT owner, type, status, event_id,
    strftime(max(CASE WHEN before IS NULL OR before <> status THEN ts END)
      OVER (PARTITION BY owner, type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), '%Y-%m-%dT%H:%M:%S.%fZ') AS last_transition
  FROM marked)
"""


@query(f"WITH {CONDITIONS_SQL} SELECT * FROM history")
def condition_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = condition_history(conditions(spark, sf_dir))
    return history.select(
        "owner", "type", "status", "event_id", iso_utc(F.col("last_transition")).alias("last_transition")
    )


@query(f"""
WITH {CONDITIONS_SQL}
SELECT h.owner, h.type, h.status, h.event_id, h.last_transition FROM history h
WHERE h.event_id = (SELECT max(x.event_id) FROM history x WHERE x.owner = h.owner AND x.type = h.type)
""")
def condition_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = latest_conditions(condition_history(conditions(spark, sf_dir)))
    return newest.select(
        "owner", "type", "status", "event_id", iso_utc(F.col("last_transition")).alias("last_transition")
    )


@query(f"""
SELECT {OWNER} AS owner,
  arg_max(CAST(value AS VARCHAR), ts) FILTER (event_type = 'click') AS count_text,
  arg_max(props, ts) FILTER (event_type = 'error') AS error_text,
  arg_max(event_type, ts) AS phase
FROM events GROUP BY ALL
""")
def status_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status updates that set some fields each, folded to the newest value of every field."""
    updates = table(spark, sf_dir, "events").selectExpr(
        f"{OWNER} AS owner",
        "ts",
        "event_id",
        "CASE WHEN event_type = 'click' THEN CAST(value AS STRING) END AS count_text",
        "CASE WHEN event_type = 'error' THEN props END AS error_text",
        "event_type AS phase",
    )
    return merge_status(updates, ["count_text", "error_text", "phase"])


CLOSED_SQL = f"""
{ERRORS_SQL}, {REGISTRY_SQL},
counted AS (SELECT 'ns_' || source AS owner, count(*) AS n_documents FROM documents GROUP BY ALL),
closed AS (
  SELECT r.owner, length(r.name) AS seconds, coalesce(n_documents, 0) AS n_documents,
    coalesce(n_errors, 0) AS n_errors, summary, n_errors IS NULL AS succeeded,
    CASE WHEN n_errors IS NULL THEN 'v2' ELSE 'v1' END AS checkpoint
  FROM registry r LEFT JOIN counted c ON r.owner = c.owner LEFT JOIN summed s ON r.owner = s.owner)
"""


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ended = registry(spark, sf_dir).select(
        "owner",
        F.lit(1).alias("run_id"),
        run_ts().alias("start_time"),
        F.timestamp_seconds(F.unix_timestamp(run_ts()) + F.length("name")).alias("end_time"),
        F.lit("v2").alias("checkpoint"),
        F.lit("v1").alias("last_checkpoint"),
    )
    return close_runs(ended, index_of(new_tree(spark, sf_dir)), _errors(spark, sf_dir), "event_id")


@query(f"""
WITH {CLOSED_SQL}
SELECT owner, CAST(seconds AS BIGINT) AS seconds, n_documents, n_errors, summary, succeeded, checkpoint FROM closed
""")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status row of every source's run; the checkpoint only moves past a run without errors."""
    return _closed(spark, sf_dir).drop("run_id", "last_run")


@query(f"""
WITH {CLOSED_SQL}
SELECT owner, 'Succeeded' AS type, succeeded AS status,
  CASE WHEN succeeded THEN 'IndexingCompleted' ELSE 'IndexingErrors' END AS reason,
  CASE WHEN succeeded THEN 'Indexing completed successfully' ELSE 'Indexing completed with errors: ' || summary END AS message
FROM closed
UNION ALL
SELECT owner, 'Error', NOT succeeded, CASE WHEN succeeded THEN 'IndexingCompleted' ELSE 'IndexingErrors' END,
  CASE WHEN succeeded THEN 'No errors during indexing' ELSE 'Indexing completed with errors: ' || summary END
FROM closed
UNION ALL SELECT owner, 'Failed', false, 'IndexingCompleted', 'Indexing completed successfully' FROM closed
UNION ALL SELECT owner, 'Indexing', false, 'IndexingCompleted', 'Document indexing process completed successfully' FROM closed
""")
def run_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conditions_of(_closed(spark, sf_dir)).drop("ts")


@query(f"""
WITH {RUNS_SQL}
SELECT owner, run_id, outcome FROM runs r
WHERE run_id = (SELECT max(x.run_id) FROM runs x WHERE x.owner = r.owner)
""")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest run of every owner: appended run rows read as current status."""
    newest = latest_rows(runs(spark, sf_dir).withColumn("outcome", outcome()), ["owner"], "start_time", "run_id")
    return newest.select("owner", "run_id", "outcome")


STILL_ACTIVE = "CASE WHEN event_type = 'signup' AND user_id % 40 < 5 THEN 1 ELSE 0 END"


@query(f"""
WITH {REGISTRY_SQL}
SELECT owner, schedule FROM registry
WHERE coalesce(suspend, false) = false
  AND owner NOT IN (SELECT {OWNER} FROM events WHERE event_type = 'signup' AND user_id % 40 < 5)
""")
def runnable_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = table(spark, sf_dir, "events").selectExpr(f"{OWNER} AS owner", f"{STILL_ACTIVE} AS active")
    return runnable(registry(spark, sf_dir), active).select("owner", "schedule")
