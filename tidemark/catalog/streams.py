"""The streaming jobs, run to the end of their input; each must equal its batch twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import rows_to_text
from ..operators.changes import changed_files, deleted_ids, resolve_doc_ids
from ..plans.index_table import IndexTable
from ..session import cut, scratch_path
from ..streaming.feeds import apply_stream, carried_flags, drift_flags, land_counts, land_new, read_stream, window_drift
from .changes import RESOLVED_SQL, scoped_feed
from .inputs import OWNER, SCOPE, index_of, new_tree, old_index, table
from .registry import query
from .rows import EVENT_TEXT_SQL


def _runs(spark: SparkSession, rows: DataFrame, part: Column, run: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Land the rows in four parts with a run after each; the last run has lost its checkpoint.

    Part 2 lands twice, before and after part 1, and time runs backwards from part to part where ``part`` says so.
    """
    home = scratch_path(spark, "stream")
    marked = cut(rows.withColumn("_part", part), "parts")
    out = None
    for i, number in enumerate((2, 1, 2, 0)):
        marked.where(F.col("_part") == number).drop("_part").write.mode("append").parquet(f"{home}/in")
        stream = read_stream(spark, f"{home}/in", rows.schema, files_per_batch=64)
        out = run(stream, f"{home}/checkpoint-{int(i == 3)}")
    return out


def _third() -> Column:
    """Later events land first: the part is the day of the month, in thirds."""
    return F.coalesce(F.floor(F.least(F.dayofmonth("ts"), F.lit(30)) / 11).cast("int"), F.lit(0))


@query(f"SELECT event_id, {EVENT_TEXT_SQL} AS text FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def stream_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New events as documents, each once: some come late, some twice, and all again after a lost checkpoint."""
    landed = scratch_path(spark, "landed")
    events = table(spark, sf_dir, "events")

    def run(stream: DataFrame, checkpoint: str) -> DataFrame:
        fresh = stream.where(F.col("ts") > F.lit("2024-01-15").cast("timestamp_ntz"))
        return land_new(fresh, "event_id", landed, checkpoint)

    rows = _runs(spark, events, _third(), run).drop("stream", "batch_id")
    return rows_to_text(rows).select("event_id", "text")


def _windows(spark: SparkSession, sf_dir: str, width: str = "5 minutes") -> DataFrame:
    timed = table(spark, sf_dir, "events").selectExpr("event_id", f"{OWNER} AS owner", "CAST(ts AS TIMESTAMP) AS ts")
    landed, counted = scratch_path(spark, "landed"), scratch_path(spark, "windows")

    def run(stream: DataFrame, checkpoint: str) -> DataFrame:
        land_new(stream, "event_id", landed, checkpoint)
        once = read_stream(spark, landed, stream.schema)
        return land_counts(once, ["owner"], "ts", width, counted, f"{checkpoint}-counts")

    return _runs(spark, timed, _third(), run)


WINDOWS_SQL = f"""
windows AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, {OWNER} AS owner, count(*) AS n
            FROM events GROUP BY ALL)
"""


@query(f"WITH {WINDOWS_SQL} SELECT strftime(start, '%Y-%m-%d %H:%M') AS window_start, owner, n FROM windows")
def stream_drift_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "owner", "n"
    )


# one event an hour is expected of the sources that deliver, two of sources that never did, and nothing of some of these
SILENT = "'ns_src' || (n_nationkey + 41)"
SILENT_EXPECTED = "CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 2 END"

TICKS_SQL = f"""
{WINDOWS_SQL.replace("5 minutes", "1 hour")},
owners AS (
  SELECT owner, 1 AS expected, min(start) AS since FROM windows GROUP BY owner
  UNION ALL SELECT {SILENT}, {SILENT_EXPECTED}, (SELECT min(start) FROM windows) FROM nation),
ticks AS (SELECT owner, expected, unnest(generate_series(since, (SELECT max(start) FROM windows), INTERVAL '1 hour')) AS start FROM owners),
judged AS (
  SELECT owner, start, coalesce(n, 0) AS n, CASE WHEN expected > 0 THEN coalesce(n, 0) <> expected END AS drift
  FROM ticks LEFT JOIN windows USING (owner, start))
"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(_windows(spark, sf_dir, "1 hour"), "windows")
    delivers = counts.groupBy("owner").agg(F.lit(1).cast("long").alias("expected"))
    silent = table(spark, sf_dir, "nation").selectExpr(f"{SILENT} AS owner", f"CAST({SILENT_EXPECTED} AS BIGINT) AS expected")
    return window_drift(counts, delivers.unionByName(silent), "1 hour")


@query(f"""
WITH {TICKS_SQL}
SELECT owner, coalesce(arg_max(drift, start) FILTER (drift IS NOT NULL), false) AS drift_flag,
  strftime(max(start) FILTER (drift) + INTERVAL '1 hour', '%Y-%m-%d %H:%M') AS last_detected
FROM judged GROUP BY owner
""")
def stream_drift_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flag follows the newest tick, also of sources that fell silent or never delivered."""
    flags = drift_flags(_judged(spark, sf_dir))
    return flags.select(
        "owner", "drift_flag", F.date_format("last_detected", "yyyy-MM-dd HH:mm").alias("last_detected")
    )


@query(f"""
WITH {TICKS_SQL}
SELECT strftime(start, '%Y-%m-%d %H:%M') AS window_start, owner, n, drift,
  coalesce(last_value(drift IGNORE NULLS) OVER (PARTITION BY owner ORDER BY start ROWS UNBOUNDED PRECEDING), false) AS drift_flag
FROM judged
""")
def stream_drift_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tick of every source with its count, its check and the flag after it."""
    return carried_flags(_judged(spark, sf_dir)).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "owner", "n", "drift", "drift_flag"
    )


@query(f"""
WITH {RESOLVED_SQL}
SELECT doc_key AS doc_id, source_uri, md5(text) AS text_hash FROM old_index
WHERE doc_key NOT IN (SELECT doc_key FROM resolved)
UNION ALL
SELECT r.doc_key, r.b_path, md5(n.text)
FROM resolved r JOIN new_tree n ON n.path = r.b_path WHERE r.action <> 'delete'
""")
def stream_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change feed landed in parts, applied to an index by a stream; the last run applies all of it anew."""
    out = scratch_path(spark, "apply")
    index = IndexTable(spark, f"{out}/index")
    index.index_documents(old_index(spark, sf_dir))
    feed = scoped_feed(spark, sf_dir)

    def to_documents(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        resolved = cut(resolve_doc_ids(batch, index.read()), "resolved")
        files = changed_files(new_tree(batch.sparkSession, sf_dir), resolved, SCOPE)
        return index_of(files), deleted_ids(resolved)

    def run(stream: DataFrame, checkpoint: str) -> DataFrame:
        apply_stream(stream, index, checkpoint, "feed", to_documents)
        return index.read()

    part = F.pmod(F.xxhash64("hash"), F.lit(3)).cast("int")
    return _runs(spark, feed, part, run).select("doc_id", "source_uri", F.md5("text").alias("text_hash"))
