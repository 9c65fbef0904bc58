"""The runs of single sources from end to end: files, URLs, rows; documents and error rows in one result."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_rfc3339
from ..operators.changes import documents_page
from ..operators.content import register_handler, unregister_handler
from ..operators.documents import file_documents, owner_key
from ..operators.pages import NO_TEXT
from ..plans.index_table import IndexTable
from ..plans.sync import FileSource, RowSource, UrlSource, sync_files, sync_pages, sync_rows, sync_urls
from ..session import cut, scratch_path
from .inputs import INDEX_SQL, NEW_PATH, NEW_TEXT, OLD_PATH, OWNER, TREES_SQL, diff_sql, old_index, run_ts, table
from .registry import query

# every fiftieth file cannot be read in its second version
BAD = "doc_id % 50 = 7"
KEPT = "path NOT LIKE '%.txt'"
NO_HANDLER_HASH = "md5('No suitable content handler found')"


def _outcome(index: IndexTable, errors: DataFrame) -> DataFrame:
    """Documents and error rows as (source_uri, text_hash, change_type)."""
    documents = index.read().select(
        "source_uri", F.md5("text").alias("text_hash"), F.coalesce("change_type", F.lit("put")).alias("change_type")
    )
    failed = errors.select(
        F.col("unit").alias("source_uri"), F.md5("message").alias("text_hash"), F.lit("error").alias("change_type")
    )
    return documents.unionByName(failed)


@query(f"""
WITH old_tree AS (SELECT doc_id, source, lang, {OLD_PATH} AS path, text FROM documents),
new_tree AS (SELECT doc_id, source, lang, {NEW_PATH} AS path,
             CASE WHEN {BAD} THEN '#bad' || text ELSE {NEW_TEXT} END AS text FROM documents),
{diff_sql(KEPT)}
SELECT n.path AS source_uri, md5(CASE WHEN {BAD.replace("doc_id", "n.doc_id")} THEN o.text ELSE n.text END) AS text_hash,
  CASE WHEN d.change_type IS NULL OR {BAD.replace("doc_id", "n.doc_id")} THEN 'full' WHEN d.change_type = 'A' THEN 'added'
       WHEN d.change_type = 'M' THEN 'modified' ELSE 'renamed' END AS change_type
FROM new_kept n LEFT JOIN diff d ON d.b_path = n.path LEFT JOIN old_kept o ON o.path = n.path
WHERE NOT {BAD.replace("doc_id", "n.doc_id")} OR d.change_type = 'M'
UNION ALL
SELECT path, {NO_HANDLER_HASH}, 'error' FROM new_kept WHERE {BAD}
""")
def sync_files_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full run and one by changes; files that turn unreadable keep their document and give an error row."""
    documents = table(spark, sf_dir, "documents")
    kind = "CASE WHEN {} THEN 'application/octet-stream' END AS content_type"
    old = documents.selectExpr("'v1' AS version", f"{OLD_PATH} AS path", "CAST(text AS BINARY) AS content", kind.format("false"))
    new = documents.selectExpr(
        "'v2' AS version",
        f"{NEW_PATH} AS path",
        f"CASE WHEN {BAD} THEN concat(X'00', CAST(text AS BINARY)) ELSE CAST({NEW_TEXT} AS BINARY) END AS content",
        kind.format(BAD),
    )
    captures = cut(old.unionByName(new), "captures")
    index = IndexTable(spark, scratch_path(spark, "index"))
    source = FileSource("ns_docs", "all", "docs", exclude=("*.txt",))
    sync_files(index, captures, source, "v1", None, run_ts())
    return _outcome(index, sync_files(index, captures, source, "v2", "v1", run_ts()))


@query(f"""
WITH files AS (SELECT doc_id, {OLD_PATH} AS path, text FROM documents),
old AS (SELECT path, md5(text) AS text_hash FROM files)
SELECT 'before' AS step, path AS source_uri, text_hash FROM old
UNION ALL SELECT 'stopped', path, text_hash FROM old
UNION ALL SELECT 'after', path, md5(CASE WHEN {BAD} THEN text ELSE {NEW_TEXT} END) FROM files
UNION ALL SELECT 'error', path, {NO_HANDLER_HASH} FROM files WHERE {BAD}
""")
def failfast_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unreadable file stops a strict run and nothing is written; a permissive run takes the rest and reports it."""
    kind = "CASE WHEN {} THEN 'application/octet-stream' END AS content_type"
    documents = table(spark, sf_dir, "documents")
    old = documents.selectExpr("'v1' AS version", f"{OLD_PATH} AS path", "CAST(text AS BINARY) AS content", kind.format("false"))
    new = documents.selectExpr(
        "'v2' AS version",
        f"{OLD_PATH} AS path",
        f"CASE WHEN {BAD} THEN concat(X'00', CAST(text AS BINARY)) ELSE CAST({NEW_TEXT} AS BINARY) END AS content",
        kind.format(BAD),
    )
    captures = cut(old.unionByName(new), "captures")
    index = IndexTable(spark, scratch_path(spark, "index"))

    def state(step: str) -> DataFrame:
        return cut(index.read().select(F.lit(step).alias("step"), "source_uri", F.md5("text").alias("text_hash")), step)

    strict = FileSource("ns_docs", "all", "docs", mode="failfast")
    sync_files(index, captures, strict, "v1", None, run_ts())
    before = state("before")
    try:
        sync_files(index, captures, strict, "v2", "v1", run_ts())
    except PySparkException:
        stopped = state("stopped")
    else:
        raise AssertionError("a strict run took an unreadable file")
    errors = sync_files(index, captures, FileSource("ns_docs", "all", "docs"), "v2", "v1", run_ts())
    failed = errors.select(F.lit("error").alias("step"), F.col("unit").alias("source_uri"), F.md5("message").alias("text_hash"))
    return before.unionByName(stopped).unionByName(state("after")).unionByName(failed)


@query(f"""
WITH files AS (SELECT {OLD_PATH} AS path, text FROM documents)
SELECT path AS source_uri, md5(CASE WHEN path LIKE '%.go' THEN 'rows of ' || text ELSE text END) AS text_hash FROM files
""")
def custom_handler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run with a handler of the user's own, which comes before the built-in ones for the files it takes."""
    files = table(spark, sf_dir, "documents").selectExpr("'v1' AS version", f"{OLD_PATH} AS path", "CAST(text AS BINARY) AS content")
    index = IndexTable(spark, scratch_path(spark, "index"))
    register_handler(
        "rows", 20, lambda content, content_type, ext: ext == ".go", lambda content, content_type, ext: F.concat(F.lit("rows of "), content.cast("string"))
    )
    try:
        sync_files(index, files, FileSource("ns_docs", "all", "docs"), "v1", None, run_ts())
    finally:
        unregister_handler("rows")
    return index.read().select("source_uri", F.md5("text").alias("text_hash"))


@query(f"""
WITH files AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a/' ELSE 'fix/' END || 'd' || doc_id || '.md' AS old_path,
               text || '#' || doc_id AS text FROM documents),
ids AS (SELECT *, sha256('all' || chr(1) || 'ns_docs' || chr(1) || old_path) AS first_id FROM files)
SELECT first_id AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'c/d' || doc_id || '.md' ELSE old_path END AS source_uri, md5(text) AS text_hash
FROM ids
UNION ALL
SELECT sha256(first_id || chr(1) || 'v3' || chr(1) || 'again'), old_path, md5(text || '#again') FROM ids WHERE doc_id % 3 = 0
""")
def rename_recreate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files move from a to b and on to c, while new ones appear under a: no document is lost, no id is shared."""
    text = "text || '#' || doc_id"
    files = table(spark, sf_dir, "documents")

    def version(name: str, folder: str, extra: str = "''", only: str = "true") -> DataFrame:
        path = f"CASE WHEN doc_id % 3 = 0 THEN '{folder}/' ELSE 'fix/' END || 'd' || doc_id || '.md' AS path"
        return files.where(only).selectExpr(f"'{name}' AS version", path, f"CAST({text} || {extra} AS BINARY) AS content")

    third = version("v3", "c").unionByName(version("v3", "a", "'#again'", "doc_id % 3 = 0"))
    captures = cut(version("v1", "a").unionByName(version("v2", "b")).unionByName(third), "captures")
    index = IndexTable(spark, scratch_path(spark, "index"))
    source = FileSource("ns_docs", "all", "docs")
    for name, before in (("v1", None), ("v2", "v1"), ("v3", "v2")):
        sync_files(index, captures, source, name, before, run_ts())
    return index.read().select("doc_id", "source_uri", F.md5("text").alias("text_hash"))


PAGE = "'https://example.org/p' || page_id || '.html'"


@query(f"""
SELECT {PAGE} AS source_uri, md5(CASE WHEN page_id % 3 = 0 THEN html || '#new' ELSE html END) AS text_hash, 'put' AS change_type
FROM pages WHERE page_id % 3 = 0 OR length(html) > 0
UNION ALL
SELECT {PAGE}, md5('File too large: 20000000 bytes exceeds limit of 10000000 bytes'), 'error' FROM pages WHERE page_id % 10 = 5
""")
def sync_urls_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures in two charsets; then some anew, twice in one run or with a declared length over the limit."""
    pages = table(spark, sf_dir, "pages")
    wide = F.col("page_id") % 4 == 1
    kind = F.when(wide, F.lit("text/html; charset=UTF-16")).otherwise(F.lit("text/html"))

    def captured(rows: DataFrame, text: Column, day: int, length: Column) -> DataFrame:
        return rows.select(
            F.expr(PAGE).alias("url"),
            F.when(wide, F.encode(text, "UTF-16")).otherwise(F.encode(text, "UTF-8")).alias("content"),
            kind.alias("content_type"),
            length.cast("long").alias("content_length"),
            F.lit(f"2024-01-0{day}").cast("timestamp").alias("at"),
        )

    index = IndexTable(spark, scratch_path(spark, "index"))
    source = UrlSource("ns_web", "web", max_size=10_000_000, ts="at")
    sync_urls(index, captured(pages, F.col("html"), 1, F.lit(None)), source, run_ts())
    some, html = pages.where("page_id % 3 = 0"), F.coalesce("html", F.lit(""))
    again = captured(some, F.concat(html, F.lit("#new")), 3, F.lit(None))
    again = again.unionByName(captured(some, F.concat(html, F.lit("#old")), 2, F.lit(None)))
    huge = captured(pages.where("page_id % 10 = 5"), F.lit("cut off"), 4, F.lit(20_000_000))
    return _outcome(index, sync_urls(index, cut(again.unionByName(huge), "captures"), source, run_ts()))


BOOK = "'https://example.org/c' || conv_id || '.pdf'"


@query(f"""
WITH pages AS (
  SELECT {BOOK} AS url, turn + 1 AS page, CASE WHEN conv_id % 5 > 0 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS text
  FROM conversations)
SELECT url AS source_uri,
  md5(string_agg('--- Page ' || page || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page)) AS text_hash, 'put' AS change_type
FROM pages WHERE text <> '' GROUP BY url
UNION ALL
SELECT url, md5('{NO_TEXT}'), 'error' FROM pages GROUP BY url HAVING count(*) FILTER (text <> '') = 0
""")
def sync_pages_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page rows as documents; those without any text give an error row."""
    pages = table(spark, sf_dir, "conversations").selectExpr(
        f"{BOOK} AS doc_id", "turn + 1 AS page_num", "CASE WHEN conv_id % 5 > 0 THEN text ELSE ' ' END AS text"
    )
    index = IndexTable(spark, scratch_path(spark, "index"))
    return _outcome(index, sync_pages(index, pages, None, UrlSource("ns_web", "books"), run_ts()))


MIDDLE = "TIMESTAMP '2024-01-15 00:00:00'"


@query(f"""
SELECT CAST(event_id AS VARCHAR) AS source_uri,
  md5('event_id: ' || event_id || chr(10) || 'ts: ' || CASE WHEN ts > {MIDDLE} THEN ts + INTERVAL 1 HOUR ELSE ts END || chr(10)
      || 'note: ' || CASE WHEN ts > {MIDDLE} THEN 'late' ELSE 'first' END) AS text_hash
FROM events
""")
def sync_rows_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows up to a day, then what is newer than the checkpoint, each key twice: the newer row stays."""
    events = table(spark, sf_dir, "events")
    early = events.selectExpr("event_id", "ts", "'first' AS note")
    late = events.selectExpr("event_id", "ts + INTERVAL 1 HOUR AS ts", "'late' AS note").where(f"ts - INTERVAL 1 HOUR > {MIDDLE}")
    early.unionByName(late).createOrReplaceTempView("rows_of_run")
    source = RowSource(
        "ns_db",
        "facts",
        f"SELECT * FROM rows_of_run WHERE note = 'first' AND ts <= {MIDDLE}",
        "SELECT * FROM rows_of_run WHERE ts > $LAST_INDEXING_TIMESTAMP",
        "event_id",
        "ts",
    )
    index = IndexTable(spark, scratch_path(spark, "index"))
    mark = sync_rows(spark, index, source, None, run_ts(), "r1")
    sync_rows(spark, index, source, mark, run_ts(), "r2")
    return index.read().select("source_uri", F.md5("text").alias("text_hash"))


@query(f"""
WITH {TREES_SQL}, {INDEX_SQL}
SELECT doc_key AS doc_id, source_uri, count(*) OVER () AS total_items FROM old_index
WHERE index_name = 'idx-en' AND language = 'python' ORDER BY doc_key LIMIT 20 OFFSET 5
""")
def page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = documents_page(old_index(spark, sf_dir), "idx-en", {"language": "python"}, limit=20, offset=5)
    return page.select("doc_id", "source_uri", "total_items")


@query(f"""
SELECT {OWNER.replace("ns_", "")} AS name, 'ns_' || {OWNER.replace("ns_", "")} AS owner,
  strftime(max(CASE WHEN event_id % 5 > 0 THEN date_trunc('second', ts) END), '%Y-%m-%d %H:%M:%S') AS newest,
  count(*) FILTER (event_id % 5 = 0) AS n_unreadable
FROM events GROUP BY ALL
""")
def owner_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners out of namespace and name; times out of RFC 3339 text, of which some is none."""
    written = F.when(F.col("event_id") % 5 == 0, F.lit("yesterday")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    events = table(spark, sf_dir, "events").selectExpr("event_id", "ts", f"{OWNER.replace('ns_', '')} AS name")
    timed = events.withColumn("time", parse_rfc3339(written))
    return timed.groupBy("name", owner_key(F.lit("ns"), F.col("name")).alias("owner")).agg(
        F.date_format(F.max("time"), "yyyy-MM-dd HH:mm:ss").alias("newest"),
        F.count_if(F.col("time").isNull()).alias("n_unreadable"),
    )


@query("SELECT source, count(*) FILTER (doc_id % 4 > 1 AND length(text) > 0) AS n_documents FROM documents GROUP BY source")
def empty_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty and missing texts give no document."""
    files = table(spark, sf_dir, "documents").selectExpr(
        "source", f"{NEW_PATH} AS path", "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE text END AS text"
    )
    made = file_documents(files, index_name="all", owner=F.col("source"), run_ts=run_ts()).groupBy("owner").agg(F.count("*").alias("n"))
    sources = files.select("source").distinct()
    return sources.join(made, sources["source"] == made["owner"], "left").select(
        "source", F.coalesce("n", F.lit(0)).cast("long").alias("n_documents")
    )
