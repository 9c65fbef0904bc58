"""Expected against actual document counts, and what to do about the difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def skip_reason() -> Column:
    """Why a source is not checked, first reason wins; null when it is."""
    return (
        F.when(F.col("policy") == "Ignore", F.lit("policy"))
        .when(~F.col("phase").eqNullSafe(F.lit("Scheduled")), F.lit("phase"))
        .when(F.coalesce("expected", F.lit(0)) == 0, F.lit("empty"))
        .when(F.coalesce("suspend", F.lit(False)), F.lit("suspended"))
    )


def drift_report(status: DataFrame, index: DataFrame) -> DataFrame:
    """One row per source: expected, actual, ``outcome`` and ``action``.

    ``status`` has ``owner, index_name, policy, phase, suspend, expected``, and ``count_failed`` where
    counts may fail: those sources are ``error`` and nothing is done about them. Documents are counted
    per index and owner first, so the join sees one row per source.
    """
    actual = index.groupBy("index_name", "owner").agg(F.count("*").alias("actual"))
    joined = status.join(actual, ["index_name", "owner"], "left").withColumn(
        "actual", F.coalesce("actual", F.lit(0).cast("long"))
    )
    reason = skip_reason()
    failed = F.coalesce("count_failed", F.lit(False)) if "count_failed" in status.columns else F.lit(False)
    result = (
        F.when(reason.isNotNull(), F.concat(F.lit("skipped:"), reason))
        .when(failed, F.lit("error"))
        .when(F.col("expected") != F.col("actual"), F.lit("drift"))
        .otherwise(F.lit("clean"))
    )
    return joined.withColumn("outcome", result).withColumn(
        "action", F.when(F.col("outcome") == "drift", F.lit("TriggerJob")).otherwise(F.lit("None"))
    )


def drift_tally(report: DataFrame) -> DataFrame:
    return report.groupBy("outcome").agg(F.count("*").alias("n_sources"))


def _flag_keys(flags: DataFrame, report: DataFrame) -> list[str]:
    """What a flag belongs to: an owner may fill several indexes, each with a check of its own."""
    both = "index_name" in flags.columns and "index_name" in report.columns
    return ["owner", "index_name"] if both else ["owner"]


def update_drift_flags(flags: DataFrame, report: DataFrame, now: Column) -> DataFrame:
    """The drift flags after one pass, one per owner, or per owner and index where both frames name the index.

    ``drift`` sets the flag and stamps the time; ``clean`` clears it; skipped sources and
    failed checks leave it as it was.
    """
    keys = _flag_keys(flags, report)
    joined = flags.join(report.select(*keys, "outcome"), keys, "full_outer")
    drifted = F.col("outcome") == "drift"
    return joined.select(
        *keys,
        F.when(drifted, F.lit(True))
        .when(F.col("outcome") == "clean", F.lit(False))
        .otherwise(F.coalesce("drift_flag", F.lit(False)))
        .alias("drift_flag"),
        F.when(drifted, now).otherwise(F.col("last_detected")).alias("last_detected"),
        "last_remediated",
    )


def already_remediated() -> Column:
    """The last remediation is newer than the last detection; false when either is unknown."""
    return F.coalesce(F.col("last_remediated") > F.col("last_detected"), F.lit(False))


def reset_candidates(report: DataFrame, flags: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources whose index is to be dropped: drifted, policy Auto, not yet remediated, nothing running."""
    busy = runs.where(F.col("active") > 0).select("owner").distinct()
    keys = _flag_keys(flags, report)
    return (
        report.where((F.col("outcome") == "drift") & (F.col("policy") == "Auto"))
        .join(flags.select(*keys, "last_detected", "last_remediated"), keys, "left")
        .where(~already_remediated())
        .join(busy, "owner", "left_anti")
    )


def existing_indexes(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """The wanted rows whose index exists; names are compared without regard to case."""
    names = index.select(F.lower("index_name").alias("_name")).distinct()
    return wanted.join(names, F.lower(wanted["index_name"]) == names["_name"], "left_semi")


def drop_indexes(index: DataFrame, names: DataFrame) -> DataFrame:
    """The index table without the named indexes; names are compared without regard to case."""
    gone = names.select(F.lower("index_name").alias("_name")).distinct()
    return index.join(gone, F.lower(index["index_name"]) == gone["_name"], "left_anti")


def reset_status(status: DataFrame, reset: DataFrame, now: Column) -> DataFrame:
    """Checkpoint and count cleared for reset sources, with the time of the reset."""
    marked = reset.select("owner", F.lit(True).alias("_reset")).distinct()
    joined = status.join(marked, "owner", "left")
    hit = F.coalesce("_reset", F.lit(False))
    return (
        joined.withColumn("expected", F.when(hit, F.lit(0).cast("long")).otherwise(F.col("expected")))
        .withColumn("checkpoint", F.when(~hit, F.col("checkpoint")))
        .withColumn("last_remediated", F.when(hit, now).otherwise(F.col("last_remediated")))
        .drop("_reset")
    )
