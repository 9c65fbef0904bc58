"""Drift, spec quality and lifecycle reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import iso_utc
from ..operators.drift import drift_report as report_drift
from ..operators.drift import (
    drift_tally as tally_drift,
)
from ..operators.drift import drop_indexes, existing_indexes, reset_candidates, reset_status, update_drift_flags
from ..operators.lifecycle import droppable
from ..operators.lifecycle import next_phase as step_phases
from ..operators.quality import check_specs, job_label
from ..operators.quality import orphan_sources as find_orphans
from ..operators.quality import spec_hash as hash_spec
from ..session import cut
from .inputs import REGISTRY_SQL, index_of, old_tree, registry, runs, run_ts, table
from .registry import query

# What the last runs recorded: the count of each source's files, off by one for some sources.
RECORDED = "CASE WHEN source IN ('src2', 'src5', 'src9', 'src13', 'src14', 'src17') THEN 1 ELSE 0 END"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of a source in the index named after it."""
    docs = index_of(old_tree(spark, sf_dir))
    number = F.regexp_extract("owner", r"\d+$", 0)
    return docs.withColumn("index_name", F.concat(F.lit("IDX-"), number))


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "documents").groupBy(
        F.concat(F.lit("ns_"), "source").alias("owner"), F.expr(RECORDED).alias("extra")
    ).agg(F.count("*").alias("n"))
    expected = expected.select("owner", (F.col("n") + F.col("extra")).alias("expected"))
    return (
        registry(spark, sf_dir)
        .join(expected, "owner", "left")
        .select(
            "owner",
            F.concat(F.lit("IDX-"), F.regexp_extract("owner", r"\d+$", 0)).alias("index_name"),
            "policy",
            F.col("drift_phase").alias("phase"),
            "suspend",
            F.coalesce("expected", F.lit(0).cast("long")).alias("expected"),
            F.lit("v1").alias("checkpoint"),
            F.lit(None).cast("timestamp").alias("last_remediated"),
        )
    )


DRIFT_SQL = f"""
{REGISTRY_SQL},
counted AS (SELECT 'ns_' || source AS owner, count(*) AS actual, count(*) + max({RECORDED}) AS expected
            FROM documents GROUP BY source),
gated AS (
  SELECT r.owner, r.policy, coalesce(c.expected, 0) AS expected, coalesce(c.actual, 0) AS actual,
    CASE WHEN r.policy = 'Ignore' THEN 'skipped:policy'
         WHEN r.drift_phase <> 'Scheduled' THEN 'skipped:phase'
         WHEN c.expected IS NULL THEN 'skipped:empty'
         WHEN r.suspend THEN 'skipped:suspended'
         WHEN c.expected <> c.actual THEN 'drift' ELSE 'clean' END AS outcome
  FROM registry r LEFT JOIN counted c ON r.owner = c.owner)
"""


@query(f"""
WITH {DRIFT_SQL}
SELECT owner, expected, actual, outcome, CASE WHEN outcome = 'drift' THEN 'TriggerJob' ELSE 'None' END AS action
FROM gated
""")
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = report_drift(_status(spark, sf_dir), _index(spark, sf_dir))
    return report.select("owner", "expected", "actual", "outcome", "action")


@query(f"WITH {DRIFT_SQL} SELECT outcome, count(*) AS n_sources FROM gated GROUP BY outcome")
def drift_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally_drift(report_drift(_status(spark, sf_dir), _index(spark, sf_dir)))


# flags from the pass before: half of the sources were drifted, some of them were remediated since
FLAGS = (
    "owner",
    "drift_flag",
    "CASE WHEN drift_flag THEN TIMESTAMP '2024-01-20 00:00:00' END AS last_detected",
    "CASE WHEN length(owner) % 2 = 0 THEN TIMESTAMP '2024-01-25 00:00:00' END AS last_remediated",
)


# every source fills a second index, too, that holds nothing yet
SECOND = "replace(index_name, 'IDX-', 'ALT-')"


@query(f"""
WITH {DRIFT_SQL}, flags AS (SELECT {', '.join(FLAGS)} FROM registry),
checks AS (
  SELECT owner, 'IDX-' || substr(owner, 7) AS index_name, outcome FROM gated
  UNION ALL
  SELECT owner, 'ALT-' || substr(owner, 7),
    CASE WHEN policy = 'Ignore' THEN 'skipped:policy' WHEN drift_phase <> 'Scheduled' THEN 'skipped:phase'
         WHEN suspend THEN 'skipped:suspended' ELSE 'drift' END FROM registry)
SELECT f.owner, g.index_name,
  CASE g.outcome WHEN 'drift' THEN true WHEN 'clean' THEN false ELSE f.drift_flag END AS drift_flag,
  CASE WHEN g.outcome = 'drift' THEN '2024-02-01T00:00:00.000000Z'
       WHEN f.last_detected IS NOT NULL THEN '2024-01-20T00:00:00.000000Z' END AS last_detected
FROM flags f JOIN checks g ON f.owner = g.owner
""")
def drift_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source has a flag for each of its two indexes, and a check of one leaves the other's flag alone."""
    status = _status(spark, sf_dir)
    second = status.withColumn("index_name", F.expr(SECOND)).withColumn("expected", F.lit(5).cast("long"))
    report = report_drift(status.unionByName(second), _index(spark, sf_dir))
    named = registry(spark, sf_dir).selectExpr(*FLAGS).join(status.select("owner", "index_name"), "owner")
    flags = named.unionByName(named.withColumn("index_name", F.expr(SECOND)))
    after = update_drift_flags(flags, report, run_ts())
    return after.select("owner", "index_name", "drift_flag", iso_utc(F.col("last_detected")).alias("last_detected"))


BUSY = "CASE WHEN user_id % 3 = 0 AND event_type = 'signup' AND user_id % 40 > 20 THEN 1 ELSE 0 END"

RESET_SQL = f"""
{DRIFT_SQL}, flags AS (SELECT {', '.join(FLAGS)} FROM registry),
busy AS (SELECT DISTINCT 'ns_src' || (user_id % 40 + 1) AS owner FROM events WHERE {BUSY} = 1),
reset AS (
  SELECT g.owner FROM gated g JOIN flags f ON g.owner = f.owner
  WHERE g.outcome = 'drift' AND g.policy = 'Auto'
    AND NOT coalesce(f.last_remediated > f.last_detected, false)
    AND g.owner NOT IN (SELECT owner FROM busy))
"""


def _reset(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    index = _index(spark, sf_dir)
    # one row per source, used by several steps
    report = cut(report_drift(_status(spark, sf_dir), index), "drift")
    flags = registry(spark, sf_dir).selectExpr(*FLAGS)
    active = table(spark, sf_dir, "events").selectExpr(
        "'ns_src' || (user_id % 40 + 1) AS owner", f"{BUSY} AS active"
    )
    chosen = reset_candidates(report.drop("last_remediated"), flags, active).withColumn(
        "index_name", F.lower("index_name")
    )
    return existing_indexes(chosen, index), index


@query(f"""
WITH {RESET_SQL}
SELECT 'ns_' || source AS owner, count(*) AS n_documents FROM documents
WHERE 'ns_' || source NOT IN (SELECT owner FROM reset) GROUP BY source
""")
def drift_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left in the index table once drifted indexes are dropped."""
    reset, index = _reset(spark, sf_dir)
    return drop_indexes(index, reset).groupBy("owner").agg(F.count("*").alias("n_documents"))


@query(f"""
WITH {RESET_SQL}
SELECT g.owner, CASE WHEN r.owner IS NULL THEN g.expected ELSE 0 END AS expected,
  CASE WHEN r.owner IS NULL THEN 'v1' END AS checkpoint,
  CASE WHEN r.owner IS NOT NULL THEN '2024-02-01T00:00:00.000000Z' END AS last_remediated
FROM gated g LEFT JOIN reset r ON g.owner = r.owner
""")
def drift_reset_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint and count of the reset sources are cleared, whatever their kind."""
    reset, _ = _reset(spark, sf_dir)
    after = reset_status(_status(spark, sf_dir), reset, run_ts())
    return after.select(
        "owner", "expected", "checkpoint", iso_utc(F.col("last_remediated")).alias("last_remediated")
    )


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit("set")
    return (
        registry(spark, sf_dir)
        .withColumn("policy", F.col("quality_policy"))
        .withColumn("urls", F.array("url"))
        .withColumn("paths", F.array(F.lit("*.md"), F.col("pattern")))
        .withColumn("exclude_paths", F.array(F.lit("vendor")))
        .withColumns({"repository": text, "language": text, "tenant_id": F.col("client_id")})
        .withColumns({"service_account": text, "scope": text})
    )


@query(f"""
WITH {REGISTRY_SQL}, hits AS (
  SELECT name, unnest([
    CASE WHEN index_name = '' THEN 'index_name:missing' END,
    CASE WHEN starts_with(index_name, 'Idx') THEN 'index_name:invalid' END,
    CASE WHEN type = 'Api' THEN 'type:invalid' END,
    CASE WHEN type = 'Git' AND branch IS NULL THEN 'branch:missing' END,
    CASE WHEN type = 'Git' AND (pattern LIKE '%//%' OR pattern LIKE '%@%') THEN 'paths:invalid' END,
    CASE WHEN type = 'Static' AND url = 'not-a-url' THEN 'urls:invalid' END,
    CASE WHEN type = 'Database' AND initial_query = '' THEN 'initial_query:missing' END,
    CASE WHEN length(schedule) < 5 THEN 'schedule:invalid' END,
    CASE WHEN quality_policy = 'Sometimes' THEN 'policy:invalid' END,
    CASE WHEN credential_type = 'Password' THEN 'credentials:invalid' END,
    CASE WHEN credential_type = 'SecretRef' AND secret_name IS NULL THEN 'secret_ref:missing' END,
    CASE WHEN credential_type = 'WorkloadIdentity' AND cloud = 'Other' THEN 'cloud:invalid' END,
    CASE WHEN credential_type = 'WorkloadIdentity' AND cloud = 'Azure' AND client_id = 'nobody' THEN 'client_id:invalid' END,
    CASE WHEN credential_type = 'WorkloadIdentity' AND cloud = 'Azure' AND client_id = 'nobody' THEN 'tenant_id:invalid' END
  ]) AS code FROM registry)
SELECT 'ns' AS namespace, name, code FROM hits WHERE code IS NOT NULL
""")
def spec_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_specs(_specs(spark, sf_dir))


@query(f"""
WITH {REGISTRY_SQL}
SELECT name, 'index_name:schema' AS code FROM registry WHERE index_name NOT LIKE 'idx-%'
UNION ALL SELECT name, 'schedule:schema' FROM registry WHERE schedule = '* *'
""")
def spec_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stricter shapes of names and schedules."""
    found = check_specs(_specs(spark, sf_dir), strict=True).where(F.col("code").endswith(":schema"))
    return found.select("name", "code")


@query(f"""
WITH {REGISTRY_SQL}
SELECT name, engine FROM registry WHERE engine NOT IN (SELECT 'eng' || r_regionkey FROM region)
""")
def orphan_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    engines = table(spark, sf_dir, "region").selectExpr("'eng' || r_regionkey AS engine")
    return find_orphans(registry(spark, sf_dir), engines).select("name", "engine")


HASHED = ("engine", "index_name", "type", "branch", "schedule")


@query(f"""
WITH {REGISTRY_SQL}
SELECT name,
  substr(sha256(concat_ws(chr(1), {', '.join(f"coalesce('=' || {c}, '-')" for c in HASHED)})), 1, 8) AS spec_hash,
  CASE WHEN schedule IS NOT NULL THEN 'scheduled-indexing' ELSE 'one-time-indexing' END AS job_type
FROM registry
""")
def spec_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark, sf_dir).select(
        "name", hash_spec(*HASHED).alias("spec_hash"), job_label(F.col("schedule")).alias("job_type")
    )


LIFE_SQL = f"""
{REGISTRY_SQL},
counted AS (
  SELECT 'ns_src' || (user_id % 40 + 1) AS owner,
    bool_or(event_type = 'signup' AND user_id % 40 < 10) AS any_running,
    bool_or(event_type = 'error') AS any_failed,
    bool_or(event_type IN ('purchase', 'click')) AS any_completed,
    arg_max(event_type, ts) FILTER (event_type <> 'view' AND NOT (event_type = 'signup' AND user_id % 40 >= 10)) = 'error'
      AS latest_failed
  FROM events GROUP BY ALL),
joined AS (
  SELECT r.*, coalesce(any_running, false) AS busy, coalesce(any_failed, false) AS any_failed,
    coalesce(any_completed, false) AS any_completed, coalesce(latest_failed, false) AS latest_failed,
    coalesce(suspend, false) AS off
  FROM registry r LEFT JOIN counted c ON r.owner = c.owner)
"""


def _life(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sources = registry(spark, sf_dir).withColumn("phase", F.col("life_phase")).drop("drift_flag")
    history = runs(spark, sf_dir).withColumn(
        "active", F.when(F.regexp_extract("owner", r"\d+$", 0).cast("int") <= 10, F.col("active")).otherwise(0)
    )
    return sources, history


@query(f"""
WITH {LIFE_SQL}
SELECT owner, life_phase AS phase,
  CASE life_phase
    WHEN 'Pending' THEN CASE WHEN schedule IS NULL THEN 'Running' WHEN off THEN 'Suspended' ELSE 'Scheduled' END
    WHEN 'Scheduled' THEN CASE WHEN off THEN 'Suspended' WHEN busy THEN 'Running'
      WHEN drift_flag AND policy IN ('Auto', 'Manual') THEN 'DriftRemediation' ELSE 'Scheduled' END
    WHEN 'Suspended' THEN CASE WHEN off THEN 'Suspended' ELSE 'Scheduled' END
    WHEN 'Running' THEN CASE WHEN busy THEN 'Running'
      WHEN any_failed AND latest_failed AND schedule IS NULL THEN 'Failed'
      WHEN any_completed AND schedule IS NULL THEN 'Completed'
      WHEN any_completed THEN 'Scheduled' ELSE 'Running' END
    WHEN 'DriftRemediation' THEN CASE WHEN policy = 'Ignore' THEN 'Pending'
      WHEN NOT drift_flag AND NOT off THEN 'Pending' ELSE 'DriftRemediation' END
    ELSE life_phase END AS next_phase,
  CASE WHEN life_phase = 'DriftRemediation' THEN
    CASE WHEN policy = 'Ignore' THEN 'leave'
         WHEN NOT drift_flag THEN CASE WHEN off THEN 'unsuspend' ELSE 'leave' END
         WHEN policy IS NULL OR policy = 'Manual' THEN 'wait-for-user'
         WHEN NOT off THEN 'suspend' WHEN busy THEN 'wait-for-runs' ELSE 'drop-index' END END AS step
FROM joined
""")
def next_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, history = _life(spark, sf_dir)
    flags = registry(spark, sf_dir).select("owner", "drift_flag")
    return step_phases(sources, history, flags)


@query(f"WITH {LIFE_SQL} SELECT owner FROM joined WHERE NOT busy")
def delete_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, history = _life(spark, sf_dir)
    return droppable(sources, history).select("owner")
