"""Positions within a group, without ever putting a whole group in one task.

A plain ``row_number`` over a key sorts the key's rows in one task, so a key with a third of all
rows stalls the job. Here rows are ordered by the MD5 of an id column. The first digits of
the MD5 split every group into even slices; each slice is numbered on its own, and the sizes of
the slices before it are added. The order depends on nothing but the data, so a lost executor or
a repeated task gives the same positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    out: str = "position",
    total: str | None = None,
    digits: int = 3,
) -> DataFrame:
    """Add the 1-based position of each row among the rows that share its keys.

    ``by`` must be unique within the keys; one null counts as a value. A group has at most ``16 ** digits`` slices. With
    ``total`` the number of rows of the group is added under that name.
    """
    # nulls form a group of their own, and equal names on both sides keep it to one shuffle
    groups = {f"_k{i}": F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for i, k in enumerate(keys)}
    sliced = (
        df.withColumns(groups)
        .withColumn("_order", F.md5(F.coalesce(F.col(by).cast("string"), F.lit("\u0000"))))
        .withColumn("_slice", F.substring("_order", 1, digits))
    )
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*groups, "_slice")
        .agg(F.count("*").alias("_size"))
        .select(
            *groups,
            "_slice",
            F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
            F.sum("_size").over(Window.partitionBy(*groups)).alias("_total"),
        )
    )
    inside = Window.partitionBy(*groups, "_slice").orderBy("_order", by)
    return (
        sliced.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*groups, "_slice"])
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .select(*df.columns, out, *([F.col("_total").alias(total)] if total else []))
    )


def batch_numbers(df: DataFrame, key: str, by: str, size: int, out: str = "batch_no") -> DataFrame:
    """Assign each row to a batch of at most ``size`` rows within its key, counting from 0."""
    return (
        number_rows(df, [key], by, out="_position")
        .withColumn(out, F.floor((F.col("_position") - 1) / size))
        .drop("_position")
    )


def progress(df: DataFrame, key: str, by: str) -> DataFrame:
    """Add ``done`` (k) and ``total`` (N) for "k of N processed" lines."""
    return number_rows(df, [key], by, out="done", total="total")
