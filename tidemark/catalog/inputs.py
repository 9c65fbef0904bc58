"""Inputs that the queries derive from the given tables, for Spark and as SQL.

The rules are plain expressions that read the same in both. Every rule is a CASE over whole tables:
no row of a table is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import with_file_type
from ..operators.documents import file_documents
from ..session import shared_dir

RUN_TS = "2024-02-01 00:00:00"

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_ts():
    return F.lit(RUN_TS).cast("timestamp")


# ---- a file tree in two versions: some files move, some are edited, some both ----

EXT = "CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.txt' ELSE '.go' END"
OLD_PATH = (
    "source || '/' || lang || '/' || CASE WHEN doc_id % 6 = 3 THEN 'inbox/' ELSE '' END"
    f" || 'd' || doc_id || {EXT}"
)
NEW_PATH = (
    "source || '/' || lang || '/' || CASE WHEN doc_id % 6 = 0 THEN 'moved/' ELSE '' END"
    f" || 'd' || doc_id || {EXT}"
)
NEW_TEXT = "text || CASE WHEN doc_id % 5 = 0 THEN '#v2' ELSE '' END"


NAMES = ("doc_id AS file_no", "source", "'ns_' || source AS owner", "'idx-' || lang AS index_name")


def old_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        *NAMES, f"{OLD_PATH} AS path", "text"
    )


def new_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        *NAMES, f"{NEW_PATH} AS path", f"{NEW_TEXT} AS text"
    )


def hashed(tree: DataFrame) -> DataFrame:
    return tree.select(
        "owner",
        "index_name",
        "path",
        F.md5("text").alias("hash"),
        F.octet_length("text").alias("size"),
    )


TREES_SQL = f"""
old_tree AS (SELECT doc_id, source, lang, {OLD_PATH} AS path, text FROM documents),
new_tree AS (SELECT doc_id, source, lang, {NEW_PATH} AS path, {NEW_TEXT} AS text FROM documents)
"""

SCOPE = ("owner", "index_name")


def diff_sql(kept: str = "true", scoped: bool = False) -> str:
    """The diff by its meaning: a path on one side only, or with another text on the other side;
    then the k-th deleted with the k-th added file of one content (and of one source)."""
    group = "source, lang, md5(text)" if scoped else "md5(text)"
    same = "g.source = c.source AND g.lang = c.lang AND" if scoped else ""
    return f"""
old_kept AS (SELECT * FROM old_tree WHERE {kept}),
new_kept AS (SELECT * FROM new_tree WHERE {kept}),
gone AS (SELECT *, md5(text) AS hash, row_number() OVER (PARTITION BY {group} ORDER BY md5(path), path) AS k
         FROM old_kept o WHERE NOT EXISTS (SELECT 1 FROM new_kept n WHERE n.path = o.path)),
come AS (SELECT *, md5(text) AS hash, row_number() OVER (PARTITION BY {group} ORDER BY md5(path), path) AS k
         FROM new_kept n WHERE NOT EXISTS (SELECT 1 FROM old_kept o WHERE n.path = o.path)),
diff AS (
  SELECT CASE WHEN g.path IS NULL THEN 'A' WHEN c.path IS NULL THEN 'D' ELSE 'R' END AS change_type,
         g.path AS a_path, c.path AS b_path, coalesce(c.hash, g.hash) AS hash
  FROM gone g FULL OUTER JOIN come c ON {same} g.hash = c.hash AND g.k = c.k
  UNION ALL
  SELECT 'M', o.path, n.path, md5(n.text) FROM old_kept o JOIN new_kept n ON o.path = n.path
  WHERE o.text <> n.text)
"""


# ---- an index over the old tree; some entries are filed under an older path ----

INDEXED_PATH = "CASE WHEN doc_id % 9 = 0 THEN 'attic/' ELSE '' END"


def index_of(tree: DataFrame) -> DataFrame:
    """Documents of a tree; changed files keep their id and carry their change's label."""
    changed = "change_label" in tree.columns
    return file_documents(
        with_file_type(tree),
        index_name=F.col("index_name"),
        owner=F.col("owner"),
        run_ts=run_ts(),
        repository="docs",
        branch="main",
        commit="v1",
        change_type=F.col("change_label") if changed else "full",
        doc_id=F.col("doc_id") if changed else None,
    )


def old_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    filed = table(spark, sf_dir, "documents").selectExpr(
        *NAMES, f"{INDEXED_PATH} || {OLD_PATH} AS path", "text"
    )
    return index_of(filed)


DOC_ID_SQL = "sha256(index_name || chr(1) || owner || chr(1) || source_uri)"

INDEX_SQL = f"""
old_index AS (
  SELECT *, {DOC_ID_SQL} AS doc_key FROM (
    SELECT doc_id, 'idx-' || lang AS index_name, 'ns_' || source AS owner, text,
           {INDEXED_PATH} || path AS source_uri,
           CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'markdown' WHEN 3 THEN 'go' END AS language
    FROM old_tree) t)
"""


# ---- runs and conditions out of the event log ----

OWNER = "'ns_src' || CAST(user_id % 40 + 1 AS STRING)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        f"{OWNER} AS owner",
        "event_id AS run_id",
        "CAST(ts AS TIMESTAMP) AS start_time",
        "CAST(ts AS TIMESTAMP) + make_dt_interval(0, 0, 0, event_id % 97 + 5) AS end_time",
        "CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS active",
        "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed",
        "CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE 0 END AS succeeded",
    )


RUNS_SQL = f"""
runs AS (
  SELECT {OWNER} AS owner, event_id AS run_id, ts AS start_time,
         event_id % 97 + 5 AS seconds,
         CASE event_type WHEN 'signup' THEN 'running' WHEN 'error' THEN 'failed'
              WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'completed' END AS outcome
  FROM events)
"""


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        f"{OWNER} AS owner", "event_type AS type", "value >= 20 AS status", "ts", "event_id"
    )


# ---- a registry of sources out of the supplier table ----

REGISTRY = {
    "namespace": "'ns'",
    "name": "'src' || s_suppkey",
    "owner": "'ns_src' || s_suppkey",
    "engine": "'eng' || (s_nationkey % 7)",
    "index_name": "CASE WHEN s_suppkey % 10 = 3 THEN 'Idx_' || s_suppkey WHEN s_suppkey % 10 = 7 THEN '' "
    "ELSE 'idx-' || s_suppkey END",
    "type": "CASE WHEN s_suppkey % 20 = 3 THEN 'Api' WHEN s_suppkey % 3 = 0 THEN 'Git' "
    "WHEN s_suppkey % 3 = 1 THEN 'Static' ELSE 'Database' END",
    "branch": "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 'main' END",
    "url": "CASE WHEN s_suppkey % 8 = 1 THEN 'not-a-url' ELSE 'https://example.org/' || s_suppkey || '.md' END",
    "pattern": "CASE s_suppkey % 4 WHEN 0 THEN 'foo//bar' WHEN 1 THEN 'src/**' WHEN 2 THEN '**/*.go' "
    "ELSE 'foo@bar' END",
    "initial_query": "CASE WHEN s_suppkey % 6 = 2 THEN '' ELSE 'select 1' END",
    "schedule": "CASE WHEN s_suppkey % 15 = 5 THEN '* *' WHEN s_suppkey % 3 = 0 THEN NULL ELSE '*/5 * * * *' END",
    "suspend": "CASE s_suppkey % 5 WHEN 0 THEN true WHEN 1 THEN false END",
    "quality_policy": "CASE WHEN s_suppkey % 11 = 0 THEN 'Sometimes' WHEN s_suppkey % 4 = 1 THEN 'Auto' "
    "WHEN s_suppkey % 4 = 2 THEN 'Manual' WHEN s_suppkey % 4 = 3 THEN 'Ignore' END",
    "policy": "CASE s_suppkey % 4 WHEN 1 THEN 'Auto' WHEN 2 THEN 'Manual' WHEN 3 THEN 'Ignore' END",
    "drift_phase": "CASE s_suppkey % 6 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Running' ELSE 'Scheduled' END",
    "life_phase": "CASE s_suppkey % 7 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Scheduled' WHEN 2 THEN 'Running' "
    "WHEN 3 THEN 'Suspended' WHEN 4 THEN 'DriftRemediation' WHEN 5 THEN 'Completed' ELSE 'Failed' END",
    "drift_flag": "s_suppkey % 2 = 0",
    "credential_type": "CASE s_suppkey % 5 WHEN 0 THEN 'SecretRef' WHEN 1 THEN 'WorkloadIdentity' "
    "WHEN 2 THEN 'Password' END",
    "secret_name": "CASE WHEN s_suppkey % 2 = 0 THEN 'token' END",
    "secret_key": "'key'",
    "cloud": "CASE WHEN s_suppkey % 3 = 0 THEN 'Other' ELSE 'Azure' END",
    "client_id": "CASE WHEN s_suppkey % 2 = 0 THEN '123e4567-e89b-12d3-a456-426614174000' ELSE 'nobody' END",
}


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        *[f"{expr} AS {name}" for name, expr in REGISTRY.items()]
    )


REGISTRY_SQL = (
    "registry AS (SELECT "
    + ", ".join(f"{expr} AS {name}" for name, expr in REGISTRY.items())
    + " FROM supplier)"
)
