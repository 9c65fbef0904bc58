from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions.text import is_pdf
from tidemark.operators.content import NO_HANDLER, TEXT, Handler, default_handlers, extract_text, route
from tidemark.operators.pages import NO_TEXT, assemble_pages, documents_without_text
from tidemark.operators.sinks import checked, error_rows

SCHEMA = "id int, content binary, content_type string, ext string"


@pytest.fixture
def files(spark):
    rows = [
        (1, b"%PDF-1.7", "application/pdf", ".pdf"),
        (2, b"plain", "text/plain", ".txt"),
        (3, b"%PDF-1.7", "application/octet-stream", ""),
        (4, b"%PDF-1.7", "application/octet-stream", ".bin2"),
        (5, b"\x00\x01", "application/octet-stream", ""),
        (6, b"\x00\x01", "TEXT/plain", ".txt"),
        (7, b"select 1", "application/sql", ".sql"),
        (8, b"sel\x00ect", "application/sql", ".sql"),
        (9, b"{}", "application/json; charset=utf-8", ".json"),
        (10, b"plain", None, None),
        (11, b"x", "application/pdf", ".PDF"),
    ]
    return spark.createDataFrame([(i, bytearray(c), t, e) for i, c, t, e in rows], SCHEMA)


def test_routing(files):
    got = {r.id: r.handler for r in route(files).collect()}
    assert got == {
        1: "pdf", 2: "text", 3: "pdf", 4: "text", 5: None, 6: "text", 7: "text", 8: None, 9: "text", 10: "text",
        11: "pdf",
    }


def test_priority_decides(files):
    first = Handler("mine", 99, lambda c, t, e: is_pdf(c), lambda c, t, e: F.lit("mine"))
    got = {r.id: (r.handler, r.text) for r in extract_text(files, [TEXT, first]).collect()}
    assert got[3] == ("mine", "mine") and got[2] == ("text", "plain")
    assert [h.name for h in default_handlers()] == ["pdf", "text"]


def test_errors_are_rows_not_failures(files, rows):
    out = extract_text(files)
    assert rows(error_rows(out.where("id = 5"), "id", "me")) == [("me", "5", NO_HANDLER)]
    assert {r.id for r in checked(out).collect()} == {2, 4, 6, 7, 9, 10}


def test_failfast_stops_the_job(files):
    out = extract_text(files)
    with pytest.raises(PySparkException, match="No suitable content handler"):
        checked(out.where("id in (2, 5)"), "failfast").collect()
    assert checked(out.where("id = 2"), "failfast").count() == 1
    with pytest.raises(ValueError):
        checked(out, "other")


PAGES = "doc_id int, page_num int, text string"
TABLES = "doc_id int, page_num int, table_num int, cells array<array<string>>"


def test_pages_and_tables_in_order(spark):
    pages = spark.createDataFrame([(1, 2, " two "), (1, 1, "one\n"), (1, 3, " \n"), (2, 1, None), (3, 10, "x"), (3, 9, "y")], PAGES)
    tables = spark.createDataFrame([(1, 1, 2, [["c"]]), (1, 1, 1, [["a", None], [None, None]]), (1, 3, 1, [[None]])], TABLES)
    got = {(r.doc_id, r.part): r.text for r in assemble_pages(pages, tables).collect()}
    assert got == {
        (1, 0): "--- Page 1 ---\none\n\n--- Page 1 Table 1 ---\na | \n\n--- Page 1 Table 2 ---\nc\n\n--- Page 2 ---\ntwo".replace("a | \n\n", "a |\n\n"),
        (3, 0): "--- Page 9 ---\ny\n\n--- Page 10 ---\nx",
    }
    assert [tuple(r) for r in documents_without_text(pages, tables).collect()] == [("2", NO_TEXT)]


def test_long_documents_come_in_parts_that_join_to_the_whole(spark):
    pages = spark.range(1, 26).select(
        F.lit(7).alias("doc_id"), F.col("id").alias("page_num"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("text")
    )
    parts = assemble_pages(pages, pages_per_part=10).orderBy("part").collect()
    assert [r.part for r in parts] == [0, 1, 2]
    whole = assemble_pages(pages).first().text
    assert "\n\n".join(r.text for r in parts) == whole
    assert whole.count("--- Page ") == 25
