"""What a run leaves behind: a status row and condition events for its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import error_summary

# ---- fixed values: condition types, reasons and messages at the end of a run ----

SUCCEEDED, ERROR, FAILED, INDEXING = "Succeeded", "Error", "Failed", "Indexing"
COMPLETED, ERRORS = "IndexingCompleted", "IndexingErrors"
COMPLETED_TEXT = "Indexing completed successfully"
NO_ERRORS_TEXT = "No errors during indexing"
ERRORS_TEXT = "Indexing completed with errors: "
PROCESS_TEXT = "Document indexing process completed successfully"

# ---- end of fixed values ----


def close_runs(runs: DataFrame, index: DataFrame, errors: DataFrame, order_by: str) -> DataFrame:
    """One status row per finished run.

    ``runs`` has one row per owner: ``owner, run_id, start_time, end_time, checkpoint, last_checkpoint``,
    and ``index_name`` where an owner may have documents in several indexes: the documents counted are
    those of the run's index. The checkpoint moves on only when the run had no
    error, so a failed run is repeated from where the last good one ended.
    """
    keys = ["owner", "index_name"] if "index_name" in runs.columns else ["owner"]
    counted = index.groupBy(*keys).agg(F.count("*").alias("n_documents"))
    zero = F.lit(0).cast("long")
    good = F.col("n_errors") == 0
    return (
        runs.join(counted, keys, "left")
        .join(error_summary(errors, order_by), "owner", "left")
        .withColumns({"n_documents": F.coalesce("n_documents", zero), "n_errors": F.coalesce("n_errors", zero)})
        .select(
            "owner",
            "run_id",
            F.col("end_time").alias("last_run"),
            (F.unix_timestamp("end_time") - F.unix_timestamp("start_time")).alias("seconds"),
            "n_documents",
            "n_errors",
            "summary",
            good.alias("succeeded"),
            F.when(good, F.col("checkpoint")).otherwise(F.col("last_checkpoint")).alias("checkpoint"),
        )
    )


def _condition(kind: str, status: Column, reason: Column, message: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"), status.alias("status"), reason.alias("reason"), message.alias("message")
    )


def run_conditions(closed: DataFrame) -> DataFrame:
    """The condition events a closed run gives rise to: ``(owner, ts, type, status, reason, message)``."""
    good, no = F.col("succeeded"), F.lit(False)
    reason = F.when(good, F.lit(COMPLETED)).otherwise(F.lit(ERRORS))
    trouble = F.when(good, F.lit(NO_ERRORS_TEXT)).otherwise(F.concat(F.lit(ERRORS_TEXT), F.col("summary")))
    outcome = F.when(good, F.lit(COMPLETED_TEXT)).otherwise(trouble)
    events = F.array(
        _condition(SUCCEEDED, good, reason, outcome),
        _condition(ERROR, ~good, reason, trouble),
        _condition(FAILED, no, F.lit(COMPLETED), F.lit(COMPLETED_TEXT)),
        _condition(INDEXING, no, F.lit(COMPLETED), F.lit(PROCESS_TEXT)),
    )
    return closed.select("owner", F.col("last_run").alias("ts"), F.inline(events))


def runnable(registry: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources a schedule may start: not suspended, and no run of theirs is active."""
    busy = runs.where(F.col("active") > 0).select("owner").distinct()
    awake = registry.where(~F.coalesce("suspend", F.lit(False)))
    return awake.join(busy, "owner", "left_anti")
