"""Bytes to text: URLs, charsets, handlers, pages, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import with_file_type
from ..functions.records import grid_text
from ..functions.text import decode, decode_lossy, looks_like_text
from ..functions.urls import is_valid_url, url_extension, url_path
from ..operators.content import extract_text, route
from ..operators.documents import url_documents as build_url_documents
from ..operators.pages import assemble_pages
from ..operators.sinks import checked, error_rows as failed_rows
from ..sources.captures import capture_error, explode_urls, size_error
from .inputs import run_ts, table
from .registry import query

CAPTURED_URL = "CASE WHEN page_id % 10 = 0 THEN 'not-a-url' || page_id ELSE url END"

# path, base name and extension of a URL by cutting strings, not by one regex
URL_PARTS_SQL = f"""
captured AS (SELECT page_id, html, {CAPTURED_URL} AS url FROM pages),
cut AS (SELECT *, split_part(split_part(url, '#', 1), '?', 1) AS bare FROM captured),
parts AS (SELECT *, CASE WHEN position('://' IN bare) > 0
            THEN substr(bare, position('://' IN bare) + 3) ELSE '' END AS rest FROM cut),
based AS (SELECT *, CASE WHEN position('/' IN rest) > 0 THEN list_last(string_split(rest, '/')) ELSE '' END AS base
          FROM parts),
typed AS (SELECT *, CASE WHEN position('.' IN ltrim(base, '.')) > 0
            THEN '.' || list_last(string_split(base, '.')) ELSE '' END AS ext FROM based)
"""


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "html", f"array({CAPTURED_URL}) AS urls"
    )
    return explode_urls(specs)


@query(f"""
WITH {URL_PARTS_SQL}
SELECT sha256('web' || chr(1) || 'ns_web' || chr(1) || url) AS doc_id, url AS source_uri, 'url' AS source_type,
  CASE WHEN lower(ext) IN ('.html', '.htm') THEN 'html' END AS language,
  CASE WHEN lower(ext) IN ('.html', '.htm') THEN 'code' END AS split_type,
  '2024-02-01T00:00:00.000000Z' AS stamped, md5(html) AS text_hash
FROM typed WHERE position('://' IN url) > 0 AND html <> ''
""")
def url_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = _captures(spark, sf_dir).where(is_valid_url(F.col("url")))
    typed = with_file_type(landed.withColumn("url_path", url_path(F.col("url"))), "url_path")
    documents = build_url_documents(
        typed.withColumnRenamed("html", "text"), index_name="web", owner="ns_web", run_ts=run_ts()
    )
    return documents.select(
        "doc_id",
        "source_uri",
        "source_type",
        "language",
        "split_type",
        F.col("metadata")["timestamp"].alias("stamped"),
        F.md5("text").alias("text_hash"),
    )


@query("""
SELECT page_id, octet_length(encode(html)) AS size,
  CASE WHEN octet_length(encode(html)) > 4000 THEN 'File too large: exceeds limit of 4000 bytes' END AS error
FROM pages
""")
def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("html").cast("binary")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.octet_length(content).cast("long").alias("size"), size_error(content, 4000).alias("error")
    )


def _checked_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _captures(spark, sf_dir).withColumn(
        "error", capture_error(F.col("url"), F.col("html").cast("binary"), 4000)
    )


@query(f"""
WITH captured AS (SELECT html, {CAPTURED_URL} AS url FROM pages)
SELECT 'ns_web' AS owner, url AS unit, 'Invalid URL format: ' || url AS message
FROM captured WHERE url NOT LIKE '%://%'
UNION ALL
SELECT 'ns_web', url, 'File too large: exceeds limit of 4000 bytes'
FROM captured WHERE url LIKE '%://%' AND octet_length(encode(html)) > 4000
""")
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failed_rows(_checked_captures(spark, sf_dir), "url", "ns_web")


@query(f"""
WITH captured AS (SELECT page_id, html, {CAPTURED_URL} AS url FROM pages)
SELECT page_id, url FROM captured WHERE url LIKE '%://%' AND octet_length(encode(html)) <= 4000
""")
def good_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The permissive mode: bad captures are left to the error table."""
    return checked(_checked_captures(spark, sf_dir), "permissive").select("page_id", "url")


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as bytes in several charsets, declared or not. What does not fit Latin-1 stays UTF-8."""
    fits = ~F.col("text").rlike(r"[^\x00-\x7F\x{A0}-\x{FF}]")
    latin1 = F.encode(F.when(fits, F.col("text")).otherwise(F.lit("")), "ISO-8859-1")
    utf8 = F.encode("text", "UTF-8")
    kind = F.when(F.col("doc_id") % 7 == 6, F.lit(5)).when(fits, F.col("doc_id") % 5).otherwise(F.lit(0))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(kind == 1, latin1)
        .when(kind == 2, latin1)
        .when(kind == 3, F.concat(F.lit(b"\xef\xbb\xbf"), utf8))
        .when(kind == 4, latin1)
        .when(kind == 5, F.encode("text", "UTF-16"))
        .otherwise(utf8)
        .alias("content"),
        F.when(kind == 1, F.lit("text/plain; charset=latin1; format=flowed"))
        .when(kind == 3, F.lit("text/plain; charset=UTF-8"))
        .when(kind == 4, F.lit("text/plain;charset=windows-1252"))
        .when(kind == 5, F.lit("text/plain; charset=utf-16"))
        .otherwise(F.lit("text/plain"))
        .alias("content_type"),
    )


@query("SELECT doc_id, md5(text) AS text_hash, length(text) AS n_chars FROM documents")
def decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round trip: decoding the re-encoded texts gives the texts."""
    return (
        _encoded(spark, sf_dir)
        .withColumn("text", decode(F.col("content"), F.col("content_type"), any_charset=True))
        .select("doc_id", F.md5("text").alias("text_hash"), F.length("text").cast("long").alias("n_chars"))
    )


@query("""
SELECT doc_id, md5(chr(65533) || text) AS text_hash, true AS plain_is_text, false AS broken_is_text
FROM documents
""")
def invalid_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stray byte becomes U+FFFD and fails the sniff; whole characters cut by the sample do not."""
    plain = F.col("text").cast("binary")
    broken = F.concat(F.lit(b"\xff"), plain)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(decode_lossy(broken)).alias("text_hash"),
        looks_like_text(plain).alias("plain_is_text"),
        looks_like_text(broken).alias("broken_is_text"),
    )


@query(f"""
WITH {URL_PARTS_SQL}
SELECT 'page' AS kind, page_id AS id,
  CASE WHEN lower(ext) IN ('', '.pdf') AND (page_id % 9 = 0 OR page_id % 15 = 0) THEN 'pdf'
       WHEN page_id % 9 = 0 AND page_id % 4 = 0 THEN NULL
       ELSE 'text' END AS handler
FROM typed
UNION ALL
SELECT 'document', doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'text' END FROM documents
""")
def handler_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by declared type, magic bytes and sniff; documents without a type by sniff alone."""
    pages = _captures(spark, sf_dir).select(
        F.lit("page").alias("kind"),
        F.col("page_id").alias("id"),
        F.concat(
            F.when(F.col("page_id") % 15 == 0, F.lit(b"%PDF")).otherwise(F.lit(b"")),
            F.when(F.col("page_id") % 4 == 0, F.lit(b"\x00")).otherwise(F.lit(b"")),
            F.col("html").cast("binary"),
        ).alias("content"),
        F.when(F.col("page_id") % 9 == 0, F.lit("application/pdf"))
        .otherwise(F.lit("Text/HTML; charset=utf-8"))
        .alias("content_type"),
        url_extension(F.col("url")).alias("ext"),
    )
    documents = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"),
        F.col("doc_id").alias("id"),
        F.concat(
            F.when(F.col("doc_id") % 7 == 0, F.lit(b"\x00")).otherwise(F.lit(b"")),
            F.col("text").cast("binary"),
        ).alias("content"),
        F.lit("application/octet-stream").alias("content_type"),
        F.lit(".dat").alias("ext"),
    )
    return route(pages.unionByName(documents)).select("kind", "id", "handler")


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE md5(text) END AS text_hash,
  CASE WHEN doc_id % 5 = 0 THEN 'No suitable content handler found' END AS error
FROM documents
""")
def extract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text where a handler takes the bytes, an error row where none does."""
    binary = F.when(F.col("doc_id") % 5 == 0, F.lit(b"\x00")).otherwise(F.lit(b""))
    files = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(binary, F.col("text").cast("binary")).alias("content"),
        F.lit("application/octet-stream").alias("content_type"),
        F.lit("").alias("ext"),
    )
    return extract_text(files).select("doc_id", F.md5("text").alias("text_hash"), "error")


@query("""
WITH sections AS (
  SELECT conv_id, turn + 1 AS page, 0 AS seq,
         '--- Page ' || (turn + 1) || ' ---' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS section
  FROM conversations WHERE regexp_matches(text, '\\S')
  UNION ALL
  SELECT conv_id, turn + 1, 1,
         '--- Page ' || (turn + 1) || ' Table 1 ---' || chr(10) || role || ' | ' || turn
           || chr(10) || ' | ' || length(text)
  FROM conversations),
whole AS (
  SELECT conv_id, string_agg(section, chr(10) || chr(10) ORDER BY page, seq) AS text
  FROM sections GROUP BY ALL)
SELECT conv_id AS doc_id, CAST(0 AS BIGINT) AS part, text FROM whole
""")
def page_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, turns as pages."""
    turns = table(spark, sf_dir, "conversations")
    pages = turns.selectExpr("conv_id AS doc_id", "turn + 1 AS page_num", "text")
    tables = turns.selectExpr(
        "conv_id AS doc_id",
        "turn + 1 AS page_num",
        "1 AS table_num",
        "array(array(role, CAST(turn AS STRING)), array(NULL, ''), "
        "array(NULL, CAST(length(text) AS STRING))) AS cells",
    )
    return assemble_pages(pages, tables)


@query("""
SELECT o_orderkey,
  o_orderkey || ' | ' || CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE o_orderstatus END || ' | ' || o_orderpriority
    || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE chr(10) || 'customer | ' || o_custkey END AS text
FROM orders
""")
def table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grid per order: null cells stay as gaps, rows without text go."""
    grids = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "array(array(CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderstatus END,"
        " ' ' || o_orderpriority || ' '),"
        " array(NULL, ''),"
        " CASE WHEN o_orderkey % 3 = 0 THEN array(NULL, NULL)"
        " ELSE array('customer', CAST(o_custkey AS STRING)) END) AS cells",
    )
    return grids.select("o_orderkey", grid_text(F.col("cells")).alias("text"))
