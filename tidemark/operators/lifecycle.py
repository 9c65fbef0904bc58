"""The next phase of each source, as a report; and which sources may be deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import registry_runs


def next_phase_of() -> Column:
    """One step of the lifecycle; nothing matching means the phase stays.

    Reads ``phase, schedule, suspend, policy, drift_flag, creation_failed, running, failed,
    completed, latest_failed``.
    """
    phase = F.coalesce("phase", F.lit(""))
    scheduled = F.col("schedule").isNotNull()
    suspended = F.coalesce("suspend", F.lit(False))
    drifted = F.coalesce("drift_flag", F.lit(False))
    policy = F.col("policy")
    idle = F.col("running") == 0

    pending = (
        F.when(scheduled & suspended, F.lit("Suspended"))
        .when(scheduled, F.lit("Scheduled"))
        .when(F.coalesce("creation_failed", F.lit(False)), F.lit("Failed"))
        .otherwise(F.lit("Running"))
    )
    waiting = (
        F.when(suspended, F.lit("Suspended"))
        .when(~idle, F.lit("Running"))
        .when(drifted & policy.isNotNull() & (policy != "Ignore"), F.lit("DriftRemediation"))
    )
    running = F.when(
        idle & (F.col("failed") > 0) & F.col("latest_failed") & ~scheduled, F.lit("Failed")
    ).when(
        idle & (F.col("completed") > 0),
        F.when(scheduled, F.lit("Scheduled")).otherwise(F.lit("Completed")),
    )
    remediation = F.when(
        policy.eqNullSafe(F.lit("Ignore")) | (~drifted & ~suspended), F.lit("Pending")
    )
    step = (
        F.when(phase == "Pending", pending)
        .when(phase == "Scheduled", waiting)
        .when((phase == "Suspended") & ~suspended, F.lit("Scheduled"))
        .when(phase == "Running", running)
        .when(phase == "DriftRemediation", remediation)
        .when(~phase.isin("Suspended", "Completed", "Failed"), F.lit("Pending"))
    )
    return F.coalesce(step, F.col("phase"))


def remediation_step() -> Column:
    """What a source in remediation waits for; null outside of that phase.

    Reads the columns of ``next_phase_of`` plus ``last_detected`` and ``last_remediated``.
    """
    suspended = F.coalesce("suspend", F.lit(False))
    drifted = F.coalesce("drift_flag", F.lit(False))
    done = F.coalesce(F.col("last_remediated") > F.col("last_detected"), F.lit(False))
    return F.when(
        F.col("phase") == "DriftRemediation",
        F.when(F.col("policy") == "Ignore", F.lit("leave"))
        .when(~drifted & suspended, F.lit("unsuspend"))
        .when(~drifted, F.lit("leave"))
        .when(F.coalesce("policy", F.lit("Manual")) == "Manual", F.lit("wait-for-user"))
        .when(~suspended, F.lit("suspend"))
        .when(done, F.lit("wait-for-check"))
        .when(F.col("running") > 0, F.lit("wait-for-runs"))
        .otherwise(F.lit("drop-index")),
    )


def next_phase(registry: DataFrame, runs: DataFrame, flags: DataFrame) -> DataFrame:
    """``(owner, phase, next_phase, step)`` for every registered source."""
    optional = {
        c: F.lit(None).cast(t)
        for c, t in (
            ("creation_failed", "boolean"),
            ("last_detected", "timestamp"),
            ("last_remediated", "timestamp"),
        )
        if c not in registry.columns and c not in flags.columns
    }
    rows = registry_runs(registry, runs).join(flags, "owner", "left").withColumns(optional)
    return rows.select(
        "owner", "phase", next_phase_of().alias("next_phase"), remediation_step().alias("step")
    )


def droppable(registry: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources without an active run."""
    busy = runs.where(F.col("active") > 0).select("owner").distinct()
    return registry.join(busy, "owner", "left_anti")
