"""Page texts and page tables put together as one text per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import grid_text
from ..functions.text import is_blank, strip

NO_TEXT = "Unable to extract text from PDF"


def _sections(pages: DataFrame, tables: DataFrame | None) -> DataFrame:
    """One row per page text and per table; the text is null where there is nothing to show."""
    mark = F.concat(F.lit("--- Page "), F.col("page_num").cast("string"))
    body = pages.select(
        "doc_id",
        F.col("page_num").cast("long"),
        F.lit(0).cast("long").alias("seq"),
        F.when(~is_blank(F.col("text")), F.concat(mark, F.lit(" ---\n"), strip(F.col("text")))).alias("section"),
    )
    if tables is None:
        return body
    grid = tables.withColumn("_grid", strip(grid_text(F.col("cells"))))
    heading = F.concat(mark, F.lit(" Table "), F.col("table_num").cast("string"), F.lit(" ---\n"))
    return body.unionByName(
        grid.select(
            "doc_id",
            F.col("page_num").cast("long"),
            F.col("table_num").cast("long").alias("seq"),
            F.when(~is_blank(F.col("_grid")), F.concat(heading, F.col("_grid"))).alias("section"),
        )
    )


def assemble_pages(
    pages: DataFrame, tables: DataFrame | None = None, pages_per_part: int | None = None
) -> DataFrame:
    """``(doc_id, part, text)``: marked sections in page order, joined by blank lines.

    A document is one row with part 0. With ``pages_per_part`` a longer one comes as consecutive
    parts, so no task ever holds more pages of a document than that; the parts in order, joined by a
    blank line, are its whole text.
    """
    shown = _sections(pages, tables).where(F.col("section").isNotNull())
    part = F.floor((F.col("page_num") - 1) / pages_per_part) if pages_per_part else F.lit(0).cast("long")
    ordered = F.array_sort(F.collect_list(F.struct("page_num", "seq", "section")))
    return (
        shown.groupBy("doc_id", part.alias("part"))
        .agg(ordered.alias("_sections"))
        .select("doc_id", "part", F.array_join(F.col("_sections.section"), "\n\n").alias("text"))
    )


def documents_without_text(pages: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """``(unit, message)`` for documents where no page and no table has any text."""
    return (
        _sections(pages, tables)
        .groupBy("doc_id")
        .agg(F.count("section").alias("_shown"))
        .where(F.col("_shown") == 0)
        .select(F.col("doc_id").cast("string").alias("unit"), F.lit(NO_TEXT).alias("message"))
    )
