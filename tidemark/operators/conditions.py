"""Condition events: transition times, latest state, merged status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

_KEY = ["owner", "type"]


#: Ranges of events per shuffle partition: more than one, so that they spread evenly over the tasks.
RANGES_PER_TASK = 4


def condition_history(
    events: DataFrame, ts: str = "ts", tie: str = "event_id", chunk_seconds: int | None = None, ranges: int | None = None
) -> DataFrame:
    """Add ``last_transition``: the time at which the condition last changed its status.

    An event that repeats the status keeps the older time. Events are dealt into ranges of (owner, type, time) of
    even size and written, so a condition with a third of all events, or a burst of them within a day, is many ranges: inside
    a range the changes are found by a window, then the last status and change of
    each range are carried over to the next ones, which are few rows. Events without a time come
    first; null owners and types are keys like others. With ``chunk_seconds`` the pieces are stretches of time instead, and
    nothing is written; a burst then meets in one task.
    """
    # nulls must meet in the joins, too
    named = {f"_{k}": F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in _KEY}
    keyed = events.withColumns(named)
    if chunk_seconds is not None:
        chunk = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / chunk_seconds)
        pieces = keyed.withColumn("_chunk", F.coalesce(chunk, F.lit(-(2**62))))
    else:
        pieces = in_ranges(keyed, [*named, ts, tie], ranges)
    return _pieced_history(pieces, [*named], [ts, tie]).select(*events.columns, "last_transition")


def in_ranges(df: DataFrame, by: list[str], ranges: int | None = None, out: str = "_chunk") -> DataFrame:
    """The rows dealt into even ranges of some columns, nulls first, with the number of the range; written, so that the numbers stay."""
    if ranges is None:
        ranges = RANGES_PER_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *[F.col(c).asc_nulls_first() for c in by])
    return cut(dealt.withColumn(out, F.spark_partition_id().cast("long")), "ranges")


def _pieced_history(pieces: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The history of events in pieces: ``_chunk`` ascends with the order, key by key."""
    ts = order[0]
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    changed = ~F.col("_first") & ~F.col("status").eqNullSafe(F.col("_before"))
    rows = (
        pieces.withColumns({"_before": F.lag("status").over(inside), "_first": F.row_number().over(inside) == 1})
        .withColumn("_change", F.when(changed, F.col(ts)))
        .withColumn("_local", F.max("_change").over(so_far))
    )
    # the same events, reduced to one row per piece
    at = F.struct(*order)
    chunks = rows.groupBy(*keys, "_chunk").agg(
        F.min_by("status", at).alias("_opens"),
        F.max_by("status", at).alias("_closes"),
        F.min(ts).alias("_start"),
        F.max("_change").alias("_last_change"),
    )
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = over_chunks.rowsBetween(Window.unboundedPreceding, -1)
    opens_with_change = ~F.col("_opens").eqNullSafe(F.lag("_closes").over(over_chunks)) | (
        F.row_number().over(over_chunks) == 1
    )
    carried = (
        chunks.withColumn("_at_start", F.when(opens_with_change, F.col("_start")))
        .withColumn("_carry", F.max(F.coalesce("_last_change", "_at_start")).over(earlier))
        .select(*keys, "_chunk", "_at_start", "_carry")
    )
    return (
        rows.join(carried, [*keys, "_chunk"])
        .withColumn("last_transition", F.coalesce("_local", "_at_start", "_carry"))
    )


def latest_rows(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The newest row of each key, by aggregation: each task sends one row per key it saw."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def latest_conditions(events: DataFrame, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    return latest_rows(events, _KEY, ts, tie)


def merge_status(updates: DataFrame, fields: Sequence[str], ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Fold status updates per owner: for each field the newest value that is set wins."""
    at = F.struct(ts, tie)
    return updates.groupBy("owner").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields]
    )


def patch_status(current: DataFrame, update: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One update over the current status: set fields replace, unset ones leave the old value."""
    fresh = update.select("owner", *[F.col(f).alias(f"_new_{f}") for f in fields])
    return current.join(fresh, "owner", "full_outer").select(
        "owner", *[F.coalesce(f"_new_{f}", f).alias(f) for f in fields]
    )
