"""Writes to outside services in batches, and what becomes of rows that fail."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import batch_numbers

# fixed values: rows per write, by kind of source
BATCH_SIZES = {"git": 10, "url": 10, "database": 50}

_OUTCOME = "partition int, batch int, n_rows long, first_unit string, error string"


def send_batches(
    df: DataFrame, send: Callable[[list[dict]], None], size: int, unit: str = "doc_id"
) -> DataFrame:
    """Hand the rows to ``send`` in lists of at most ``size``; one outcome row per list.

    A list that fails is recorded with its message and the next one is sent. Every partition
    sends its own rows, a batch at a time. A task that Spark repeats sends again, so
    ``send`` should be an upsert by ``doc_id``; write the outcomes once and read that table.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, number, waiting = (context.partitionId() if context else 0), 0, []

        def flush(rows: list[dict]) -> pd.DataFrame:
            error = None
            try:
                send(rows)
            except Exception as exc:  # one failed batch must not stop the others
                error = f"Failed to index document batch: {exc}"
            return pd.DataFrame(
                {
                    "partition": [part],
                    "batch": [number],
                    "n_rows": [len(rows)],
                    "first_unit": [str(rows[0].get(unit))],
                    "error": [error],
                }
            )

        for frame in frames:
            waiting.extend(frame.to_dict("records"))
            while len(waiting) >= size:
                yield flush(waiting[:size])
                number, waiting = number + 1, waiting[size:]
        if waiting:
            yield flush(waiting)

    return df.mapInPandas(run, _OUTCOME)


def send_numbered(
    df: DataFrame, send: Callable[[list[dict]], None], size: int, keys: Sequence[str], by: str, unit: str = "doc_id"
) -> DataFrame:
    """Hand the rows of each key to ``send`` in lists of ``size``, the last one shorter; ``(*keys, batch_no, n_rows, first_unit, error)``.

    Lists follow ``batch_numbers``: which rows share a list depends on the data alone, so a task that Spark repeats sends the same lists
    again, and a key of any size is spread over many tasks, whole lists in each. A list that fails is recorded and the next one is sent.
    """
    numbered = batch_numbers(df, keys[0], by, size) if len(keys) == 1 else None
    if numbered is None:
        joined = df.withColumn("_key", F.to_json(F.struct(*keys)))
        numbered = batch_numbers(joined, "_key", by, size).drop("_key")
    place = [*keys, "batch_no"]
    dealt = numbered.repartition(*place).sortWithinPartitions(*place, by)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[dict] = []

        def flush() -> pd.DataFrame:
            error, first = None, waiting[0]
            try:
                send([{k: v for k, v in row.items() if k != "batch_no"} for row in waiting])
            except Exception as exc:  # one failed list must not stop the others
                error = f"Failed to index document batch: {exc}"
            row = {**{c: [first[c]] for c in place}, "n_rows": [len(waiting)], "first_unit": [str(first.get(unit))], "error": [error]}
            return pd.DataFrame(row)

        for frame in frames:
            for row in frame.to_dict("records"):
                if waiting and any(row[c] != waiting[0][c] for c in place):
                    yield flush()
                    waiting = []
                waiting.append(row)
        if waiting:
            yield flush()

    kinds = ", ".join(f"{c} {numbered.schema[c].dataType.simpleString()}" for c in place)
    return dealt.mapInPandas(run, f"{kinds}, n_rows long, first_unit string, error string")


def good_rows(df: DataFrame, error: str = "error") -> DataFrame:
    return df.where(F.col(error).isNull()).drop(error)


def error_rows(df: DataFrame, unit: str, owner: Column | str, error: str = "error") -> DataFrame:
    """``(owner, unit, message)`` for the rows that failed."""
    owner = owner if isinstance(owner, Column) else F.lit(owner)
    return df.where(F.col(error).isNotNull()).select(
        owner.alias("owner"), F.col(unit).cast("string").alias("unit"), F.col(error).alias("message")
    )


def checked(df: DataFrame, mode: str = "permissive", error: str = "error") -> DataFrame:
    """The good rows; in ``failfast`` mode the first bad row stops the job that reads them."""
    if mode == "permissive":
        return good_rows(df, error)
    if mode != "failfast":
        raise ValueError(f"unknown mode {mode!r}")
    stop = F.when(F.col(error).isNull(), F.lit(True)).otherwise(F.raise_error(F.col(error)))
    return df.where(stop).drop(error)
