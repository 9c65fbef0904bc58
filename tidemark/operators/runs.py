"""Run history: counts, latest outcome, durations, retention, error summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def outcome() -> Column:
    """One outcome per run: active before failed before succeeded; null when none is set."""
    return (
        F.when(F.col("active") > 0, F.lit("running"))
        .when(F.col("failed") > 0, F.lit("failed"))
        .when(F.col("succeeded") > 0, F.lit("completed"))
    )


def run_counts(runs: DataFrame) -> DataFrame:
    """Per owner: running, failed, completed, and whether the newest run failed.

    The start time and the failed flag travel in one number, so all of it is plain hash
    aggregation; of two runs that start together, a failed one counts as the newer.
    """
    is_failed = F.col("outcome") == "failed"
    newest = F.max(F.when(F.col("outcome").isNotNull(), F.unix_micros("start_time") * 2 + is_failed.cast("long")))
    return (
        runs.withColumn("outcome", outcome())
        .groupBy("owner")
        .agg(
            F.count_if(F.col("outcome") == "running").alias("running"),
            F.count_if(is_failed).alias("failed"),
            F.count_if(F.col("outcome") == "completed").alias("completed"),
            newest.alias("_newest"),
        )
        .withColumn("latest_failed", F.coalesce(F.pmod("_newest", F.lit(2)) == 1, F.lit(False)))
        .drop("_newest")
    )


def registry_runs(registry: DataFrame, runs: DataFrame) -> DataFrame:
    """Each source with its run counts; runs are counted before the join."""
    counted = run_counts(runs)
    zero = F.lit(0).cast("long")
    return registry.join(counted, "owner", "left").withColumns(
        {
            "running": F.coalesce("running", zero),
            "failed": F.coalesce("failed", zero),
            "completed": F.coalesce("completed", zero),
            "latest_failed": F.coalesce("latest_failed", F.lit(False)),
        }
    )


def run_totals(runs: DataFrame) -> DataFrame:
    """Success and error counters, durations in whole seconds, and the two run-set tests.

    ``done``: something succeeded and nothing is active. ``any_failed``: some run failed.
    """
    seconds = F.unix_timestamp("end_time") - F.unix_timestamp("start_time")
    return runs.groupBy("owner").agg(
        F.count_if(F.col("succeeded") > 0).alias("success_count"),
        F.count_if(F.col("failed") > 0).alias("error_count"),
        F.max(seconds).alias("max_seconds"),
        F.sum(seconds).alias("total_seconds"),
        (F.max(F.col("succeeded") > 0) & ~F.max(F.col("active") > 0)).alias("done"),
        F.max(F.col("failed") > 0).alias("any_failed"),
    )


def retain_runs(runs: DataFrame, completed: int = 3, failed: int = 1) -> DataFrame:
    """The newest finished runs of each owner; runs without an end stay.

    Spark cuts each task's rows to the first few of every owner before the shuffle, so a busy
    owner does not end up in one task.
    """
    newest = Window.partitionBy("owner", "outcome").orderBy(F.desc("start_time"), F.desc("run_id"))
    most = max(completed, failed)
    ranked = (
        runs.withColumn("outcome", outcome())
        .where(F.col("outcome").isin("completed", "failed"))
        .withColumn("recency", F.row_number().over(newest))
        .where(F.col("recency") <= most)
    )
    keep = F.when(F.col("outcome") == "completed", F.lit(completed)).otherwise(F.lit(failed))
    finished = ranked.where(F.col("recency") <= keep).drop("recency")
    open_runs = runs.withColumn("outcome", outcome()).where(
        F.col("outcome").isNull() | (F.col("outcome") == "running")
    )
    return finished.unionByName(open_runs)


def error_summary(errors: DataFrame, order_by: str, k: int = 3) -> DataFrame:
    """Per owner: number of errors and the first ``k`` messages as one text.

    Counting is one aggregation. The first messages are picked by a ranked window that Spark
    limits before the shuffle, so no task ever holds all errors of an owner.
    """
    counts = errors.groupBy("owner").agg(F.count("*").alias("n_errors"))
    earliest = Window.partitionBy("owner").orderBy(order_by)
    first = (
        errors.withColumn("_rank", F.row_number().over(earliest))
        .where(F.col("_rank") <= k)
        .groupBy("owner")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "message"))).alias("_first"))
        .select("owner", F.array_join(F.col("_first.message"), "; ").alias("_messages"))
    )
    more = F.when(
        F.col("n_errors") > k,
        F.concat(F.lit(" (and "), (F.col("n_errors") - k).cast("string"), F.lit(" more)")),
    ).otherwise(F.lit(""))
    return (
        counts.join(first, "owner")
        .withColumn("summary", F.concat("_messages", more))
        .drop("_messages")
    )


def completion_message(n_documents: Column, seconds: Column, n_errors: Column, summary: Column) -> Column:
    """The text of a run's closing event."""
    return F.when(
        F.coalesce(n_errors, F.lit(0)) == 0,
        F.format_string(
            "Job completed successfully. Processed %d documents in %d seconds.", n_documents, seconds
        ),
    ).otherwise(
        F.concat(
            F.format_string(
                "Job failed after %d seconds. Documents indexed: %d.", seconds, n_documents
            ),
            F.when(summary.isNotNull(), F.concat(F.lit(" Errors: "), summary)).otherwise(F.lit("")),
        )
    )


def completion_events(runs: DataFrame, errors: DataFrame, order_by: str, k: int = 3) -> DataFrame:
    """One closing event per owner: ``(owner, reason, event_type, message)``.

    ``runs`` has one row per owner with ``n_documents`` and ``seconds``.
    """
    failed = F.coalesce("n_errors", F.lit(0)) > 0
    return (
        runs.join(error_summary(errors, order_by, k), "owner", "left")
        .select(
            "owner",
            F.when(failed, F.lit("IndexingFailed")).otherwise(F.lit("IndexingCompleted")).alias("reason"),
            F.when(failed, F.lit("Warning")).otherwise(F.lit("Normal")).alias("event_type"),
            completion_message(
                F.col("n_documents"), F.col("seconds"), F.col("n_errors"), F.col("summary")
            ).alias("message"),
        )
    )
