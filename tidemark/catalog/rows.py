"""Database rows as documents, incremental reads, query lineage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import all_clusters, cluster_url, database_of, first_cluster
from ..functions.records import json_map, json_of, merge_maps, preview, rows_to_text
from ..operators.documents import position_key
from ..operators.documents import row_documents as build_row_documents
from ..session import cut
from ..sources.database import run_query
from .inputs import run_ts, table
from .registry import query

EVENT_TEXT_SQL = (
    "'event_id: ' || event_id || chr(10) || 'ts: ' || ts || chr(10) || 'user_id: ' || user_id || chr(10)"
    " || 'event_type: ' || event_type || chr(10) || 'value: ' || value || chr(10) || 'props: ' || props"
)


@query(f"""
SELECT sha256('facts' || chr(1) || 'ns_db' || chr(1) || event_id) AS doc_id,
  CAST(event_id AS VARCHAR) AS source_uri, {EVENT_TEXT_SQL} AS text
FROM events
""")
def row_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = rows_to_text(table(spark, sf_dir, "events"))
    documents = build_row_documents(
        texts, key="event_id", index_name="facts", owner="ns_db", run_ts=run_ts()
    )
    return documents.select("doc_id", "source_uri", "text")


@query("""
SELECT o_orderkey,
  concat_ws(chr(10), 'o_orderkey: ' || o_orderkey,
    CASE WHEN o_orderstatus <> 'P' THEN 'status: ' || o_orderstatus END,
    CASE WHEN o_orderpriority NOT LIKE '5%' THEN 'priority: ' || o_orderpriority END) AS text
FROM orders
""")
def sparse_row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and blank values leave no line behind."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status",
        "CASE WHEN o_orderpriority LIKE '5%' THEN ' \\t ' ELSE o_orderpriority END AS priority",
    )
    return rows_to_text(rows).select("o_orderkey", "text")


INITIAL = "SELECT * FROM {view}"
INCREMENTAL = "SELECT * FROM {view} WHERE ts > $LAST_INDEXING_TIMESTAMP"


@query(f"""
SELECT event_id, {EVENT_TEXT_SQL} AS text FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'
""")
def incremental_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = "source_events"
    table(spark, sf_dir, "events").createOrReplaceTempView(view)
    rows = run_query(
        spark, INITIAL.format(view=view), INCREMENTAL.format(view=view), dt.datetime(2024, 1, 15)
    )
    return rows_to_text(rows).select("event_id", "text")


@query("""
SELECT CAST(doc_id AS VARCHAR) AS doc_id,
  CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS text,
  lang, source, CAST(n_chars AS VARCHAR) AS n_chars
FROM documents ORDER BY documents.doc_id LIMIT 3
""")
def row_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(table(spark, sf_dir, "documents"), n=3, width=100, order_by="doc_id")


@query("SELECT count(*) AS n_rows, count(*) AS n_keys FROM events")
def keyless_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five texts over all events, each a big group of copies: every row still gets its own key."""
    rows = cut(table(spark, sf_dir, "events").select(F.col("event_type").alias("text")), "rows")
    keys = position_key(rows, "run-1").groupBy("row_key").agg(F.count("*").alias("n"))
    return keys.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"))


QUERY_TEXT = (
    "CASE WHEN o_orderkey % 7 = 0 THEN 'Orders' ELSE "
    "'cluster(''' || CASE WHEN o_orderkey % 3 = 0 THEN 'https://' ELSE '' END || 'c' || (o_custkey % 50) || "
    "CASE WHEN o_orderkey % 4 = 0 THEN '.db.example.net' ELSE '' END || ''')' || "
    "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '.database(\"db_' || o_orderstatus || '\").Orders' END || "
    "CASE WHEN o_orderkey % 2 = 0 THEN ' | join cluster(\"other' || o_custkey || '\").database(''x'')' ELSE '' END END"
)


@query("""
SELECT o_orderkey,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'https://c' || (o_custkey % 50) || '.db.example.net' END AS url,
  CASE WHEN o_orderkey % 7 = 0 THEN 'default'
       WHEN o_orderkey % 5 <> 0 THEN 'db_' || o_orderstatus
       WHEN o_orderkey % 2 = 0 THEN 'x' ELSE 'default' END AS database_name,
  CAST(CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_clusters,
  o_orderkey % 7 = 0 AS missing
FROM orders
""")
def query_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{QUERY_TEXT} AS q")
    q = F.col("q")
    return texts.select(
        "o_orderkey",
        cluster_url(first_cluster(q), ".db.example.net").alias("url"),
        database_of(q, "default").alias("database_name"),
        F.size(all_clusters(q)).cast("long").alias("n_clusters"),
        first_cluster(q).isNull().alias("missing"),
    )


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'old' END AS priority,
  'kept' AS note, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status,
  CAST(CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS n_keys
FROM orders
""")
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status as an open map: the update wins key by key, what it lacks stays."""
    maps = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "map('priority', 'old', 'note', 'kept') AS old",
        "CASE WHEN o_orderkey % 2 = 0 THEN map('priority', o_orderpriority, 'status', o_orderstatus) END AS new",
    )
    merged = maps.withColumn("m", merge_maps(F.col("old"), F.col("new")))
    return merged.select(
        "o_orderkey",
        *[F.col("m")[k].alias(k) for k in ("priority", "note", "status")],
        F.size("m").cast("long").alias("n_keys"),
    )


@query("""
SELECT doc_id,
  '{"source":' || to_json(source) || ',"lang":' || to_json(lang) || ',"head":' || to_json(text) || '}' AS json,
  true AS round_trip, true AS bad_is_null
FROM documents
""")
def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata to JSON and back; a text that is no JSON object gives null."""
    rows = table(spark, sf_dir, "documents").withColumn(
        "metadata",
        F.create_map(
            F.lit("source"), "source", F.lit("lang"), "lang", F.lit("head"), "text"
        ),
    )
    encoded = rows.withColumn("json", json_of(F.col("metadata")))
    back = json_map(F.col("json"))
    same = F.coalesce(
        (back["source"] == F.col("source")) & (back["lang"] == F.col("lang")) & (back["head"] == F.col("text")),
        F.lit(False),
    )
    bad = json_map(F.concat(F.lit("not json "), F.col("source")))
    return encoded.select(
        "doc_id", "json", same.alias("round_trip"), bad.isNull().alias("bad_is_null")
    )
