"""Table rows and cell grids as text; metadata as JSON."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import is_blank, strip, truncate


def row_text(columns: Iterable[str]) -> Column:
    """``name: value`` lines in column order, without null and blank values."""
    lines = [
        F.when(
            ~is_blank(F.col(f"`{c}`").cast("string")),
            F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string")),
        )
        for c in columns
    ]
    return F.array_join(F.array(*lines), "\n")


def rows_to_text(df: DataFrame, exclude: Iterable[str] = (), out: str = "text") -> DataFrame:
    """Add the row text; rows with nothing to say are dropped."""
    skip = set(exclude)
    text = row_text([c for c in df.columns if c not in skip])
    return df.withColumn(out, text).where(F.length(out) > 0)


def preview(df: DataFrame, n: int = 3, width: int = 100, order_by: str | None = None) -> DataFrame:
    """The first ``n`` rows with every value as text, cut to ``width`` characters."""
    head = (df.orderBy(order_by) if order_by else df).limit(n)
    return head.select(*[truncate(F.col(f"`{c}`").cast("string"), width).alias(c) for c in df.columns])


def grid_text(cells: Column) -> Column:
    """A cell grid as lines of ``a | b | c``; rows without any cell text are left out."""
    filled = F.filter(
        cells, lambda row: F.exists(row, lambda c: F.coalesce(c != F.lit(""), F.lit(False)))
    )
    return F.array_join(
        F.transform(
            filled,
            lambda row: F.array_join(
                F.transform(row, lambda c: strip(F.coalesce(c, F.lit("")))), " | "
            ),
        ),
        "\n",
    )


def json_of(metadata: Column) -> Column:
    return F.to_json(metadata)


def json_map(text: Column) -> Column:
    """A JSON object of scalars as a map; null where the text is not one."""
    return F.from_json(text, "map<string,string>")


def merge_maps(old: Column, new: Column) -> Column:
    """Both maps in one; where a key is in both, the new value counts. Null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    fresh = F.coalesce(new, empty)
    kept = F.map_filter(F.coalesce(old, empty), lambda k, _: ~F.map_contains_key(fresh, k))
    return F.map_concat(kept, fresh)
