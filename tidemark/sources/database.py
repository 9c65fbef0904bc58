"""Query sources: an initial query first, an incremental one from then on."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACEHOLDER = "$LAST_INDEXING_TIMESTAMP"


def choose_query(initial: str, incremental: str | None, last_ts: dt.datetime | None) -> str:
    """The query of this run. Without an incremental query the initial one is repeated."""
    if last_ts is None or not incremental:
        return initial
    quoted = f"'{PLACEHOLDER}'"
    return incremental.replace(quoted, ":last_ts").replace(PLACEHOLDER, ":last_ts")


def run_query(
    spark: SparkSession, initial: str, incremental: str | None, last_ts: dt.datetime | None
) -> DataFrame:
    """Run the chosen query; the checkpoint is bound as a typed parameter, never pasted in."""
    query = choose_query(initial, incremental, last_ts)
    args = {"last_ts": last_ts} if ":last_ts" in query else None
    return spark.sql(query, args=args)


def high_water_mark(df: DataFrame, ts: str = "ts") -> dt.datetime | None:
    """The checkpoint to store after a successful run: the newest time actually read."""
    return df.agg(F.max(ts)).first()[0]
