"""Path filters, file types, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension, filter_paths, with_file_type
from ..operators.numbering import batch_numbers, progress
from ..operators.sinks import BATCH_SIZES, send_batches, send_numbered
from ..session import scratch_path
from ..sources.trees import read_tree
from .inputs import NEW_PATH, TREES_SQL, new_tree, table
from .registry import query

MIXED_PATH = (
    "CASE WHEN doc_id % 17 = 0 THEN '.hidden/' ELSE '' END || "
    "CASE WHEN doc_id % 19 = 0 THEN 'vendor/' ELSE '' END || "
    f"{NEW_PATH} || CASE WHEN doc_id % 23 = 0 THEN '.SO' ELSE '' END"
)


@query(f"""
WITH mixed AS (SELECT doc_id, {MIXED_PATH} AS path FROM documents)
SELECT doc_id, path, '.' || list_last(string_split(path, '.')) AS ext
FROM mixed
WHERE path NOT LIKE '.%' AND path NOT LIKE '%/.%'
  AND lower(path) NOT LIKE '%.so'
  AND NOT (path LIKE 'vendor/%' OR path LIKE '%/vendor/%')
  AND NOT (path LIKE 'src1/moved/%' OR path LIKE 'src1/%/moved/%')
  AND path NOT LIKE '%.txt'
  AND (path LIKE '%.py' OR path LIKE '%.go' OR path LIKE 'src2/%')
""")
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{MIXED_PATH} AS path")
    kept = filter_paths(
        mixed, include=["*.py", "**/*.go", "/src2/"], exclude=["vendor/", "src1/**/moved/", "*.txt"]
    )
    return kept.select("doc_id", "path", extension(F.col("path")).alias("ext"))


@query(f"""
WITH mixed AS (SELECT doc_id, {MIXED_PATH} AS path FROM documents)
SELECT doc_id, path FROM mixed
WHERE path NOT LIKE '.%' AND lower(path) NOT LIKE '%.so'
  AND NOT (path LIKE '%.md' AND path NOT LIKE 'src3/%')
  AND path NOT LIKE 'vendor/%'
""")
def path_filter_negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``!`` brings files back, but not from below an excluded folder."""
    mixed = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{MIXED_PATH} AS path")
    return filter_paths(mixed, exclude=["*.md", "vendor/", "!/src3/**/*.md", "!/vendor/**/*.go"])


VARIED_PATH = (
    "source || '/' || CASE doc_id % 12 WHEN 0 THEN 'a.py' WHEN 1 THEN 'a.PY' WHEN 2 THEN 'Dockerfile' "
    "WHEN 3 THEN 'go.mod' WHEN 4 THEN 'a.b.YAML' WHEN 5 THEN '.profile' WHEN 6 THEN 'README' "
    "WHEN 7 THEN 'a.rs' WHEN 8 THEN 'a.cpp' WHEN 9 THEN 'x.sql' WHEN 10 THEN 'x.xyz' ELSE 'x.html' END"
)


@query(f"""
SELECT doc_id,
  CASE doc_id % 12 WHEN 0 THEN 'text/x-python' WHEN 1 THEN 'text/x-python' WHEN 4 THEN 'application/x-yaml'
    WHEN 8 THEN 'text/x-c++' WHEN 9 THEN 'application/sql' WHEN 11 THEN 'text/html'
    ELSE 'text/plain' END AS content_type,
  CASE doc_id % 12 WHEN 0 THEN 'python' WHEN 1 THEN 'python' WHEN 2 THEN 'dockerfile' WHEN 3 THEN 'gomod'
    WHEN 4 THEN 'yaml' WHEN 7 THEN 'rust' WHEN 8 THEN 'cpp' WHEN 9 THEN 'sql' WHEN 11 THEN 'html' END AS language,
  CASE WHEN doc_id % 12 NOT IN (5, 6, 10) THEN 'code' END AS split_type
FROM documents
""")
def content_type_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{VARIED_PATH} AS path")
    return with_file_type(files).select("doc_id", "content_type", "language", "split_type")


@query("""
SELECT source, CAST(sum(length(CAST(doc_id AS VARCHAR)) + 34) AS BIGINT) AS n_bytes, count(*) AS n_lines
FROM documents GROUP BY source
""")
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written to a folder per source, read back as a tree of files."""
    home = scratch_path(spark, "tree")
    lines = table(spark, sf_dir, "documents").select("source", F.concat_ws(" ", "doc_id", F.md5("text")).alias("line"))
    lines.write.partitionBy("source").option("maxRecordsPerFile", 100_000).text(home)
    files = read_tree(spark, home, include=["*.txt"], exclude=["nothing/"])
    text = F.col("content").cast("string")
    return (
        files.withColumn("source", F.regexp_extract("path", "^source=([^/]+)/", 1))
        .groupBy("source")
        .agg(
            F.sum("length").alias("n_bytes"),
            F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n")))).cast("long").alias("n_lines"),
        )
    )


@query(f"""
WITH {TREES_SQL}
SELECT source, path,
  CAST((row_number() OVER (PARTITION BY source ORDER BY md5(path), path) - 1) // 10 AS BIGINT) AS batch_no
FROM new_tree
""")
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_numbers(
        new_tree(spark, sf_dir).select("source", "path"), "source", "path", BATCH_SIZES["git"]
    )


@query(f"""
WITH {TREES_SQL}
SELECT source, path,
  CAST(count(*) OVER (PARTITION BY source ORDER BY md5(path), path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done,
  count(*) OVER (PARTITION BY source) AS total
FROM new_tree
""")
def file_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress(new_tree(spark, sf_dir).select("source", "path"), "source", "path")


@query("""
SELECT source, count(*) AS n_rows, count(*) FILTER (doc_id % 10 = 3) AS n_failed FROM documents GROUP BY source
""")
def sink_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call per row to a service that refuses some rows: each refusal is recorded, the rest arrives."""

    def deliver(batch: list[dict]) -> None:
        refused = [row["doc_id"] for row in batch if row["doc_id"] % 10 == 3]
        if refused:
            raise ValueError(f"refused {refused}")

    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "source || '#' || doc_id AS unit")
    sent = send_batches(rows, deliver, 1, unit="unit")
    return sent.groupBy(F.substring_index("first_unit", "#", 1).alias("source")).agg(
        F.sum("n_rows").alias("n_rows"), F.count_if(F.col("error").isNotNull()).alias("n_failed")
    )


def _lists_sql(size: int) -> str:
    return f"""
SELECT {size} AS size, source, batch_no, count(*) AS n_rows, bool_or(doc_id % 97 = 3) AS failed
FROM (SELECT doc_id, source,
        (row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) // {size} AS batch_no FROM documents)
GROUP BY source, batch_no"""


@query(f"{_lists_sql(BATCH_SIZES['git'])} UNION ALL {_lists_sql(BATCH_SIZES['database'])}")
def sink_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of 10 and of 50 rows per source, the last one shorter: a list with a row that is refused fails, the others arrive."""

    def deliver(batch: list[dict]) -> None:
        refused = [row["doc_id"] for row in batch if row["doc_id"] % 97 == 3]
        if refused:
            raise ValueError(f"refused {refused}")

    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = None
    for size in (BATCH_SIZES["git"], BATCH_SIZES["database"]):
        sent = send_numbered(rows, deliver, size, ["source"], "doc_id")
        lists = sent.select(F.lit(size).alias("size"), "source", "batch_no", "n_rows", F.col("error").isNotNull().alias("failed"))
        out = lists if out is None else out.unionByName(lists)
    return out
