"""Snapshot diff, document ids, and the index after the changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import with_file_type
from ..operators.changes import apply_changes as apply_to_index
from ..operators.changes import changed_files, deleted_ids, resolve_doc_ids
from ..operators.diff import change_counts as count_changes
from ..operators.diff import snapshot_diff as diff_trees
from ..operators.documents import file_documents
from ..operators.likeness import pair_edited
from ..operators.tree_digests import land_digests
from ..operators.tree_digests import tree_diff as diff_digests
from ..plans.index_table import IndexTable
from ..plans.sync_all import path_columns, path_rules, sync_all
from ..session import cut, scratch_path
from ..sources.trees import land_snapshot
from .inputs import (
    INDEX_SQL,
    NAMES,
    NEW_PATH,
    OLD_PATH,
    SCOPE,
    TREES_SQL,
    diff_sql,
    hashed,
    index_of,
    new_tree,
    old_index,
    old_tree,
    run_ts,
    table,
)
from .registry import query


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_trees(hashed(old_tree(spark, sf_dir)), hashed(new_tree(spark, sf_dir)))


@query(f"WITH {TREES_SQL}, {diff_sql()} SELECT change_type, a_path, b_path, hash FROM diff")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(spark, sf_dir)


@query(f"WITH {TREES_SQL}, {diff_sql()} SELECT change_type, a_path, b_path, hash FROM diff")
def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes by digests of folders: only folders that differ are opened."""
    home = scratch_path(spark, "digests")
    for version, tree in (("v1", old_tree(spark, sf_dir)), ("v2", new_tree(spark, sf_dir))):
        land_digests(hashed(tree), home, version, buckets=16)
    return diff_digests(spark, home, "v1", "v2", buckets=16)


@query(f"WITH {TREES_SQL}, {diff_sql()} SELECT change_type, count(*) AS n FROM diff GROUP BY change_type")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_changes(_feed(spark, sf_dir))


OUTSIDE = "path NOT LIKE '%/moved/%' AND path NOT LIKE '%/inbox/%'"


@query(f"WITH {TREES_SQL}, {diff_sql(OUTSIDE)} SELECT change_type, a_path, b_path FROM diff")
def boundary_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that moves into an excluded folder is deleted, one that moves out of it is added."""
    feed = diff_trees(
        hashed(old_tree(spark, sf_dir)), hashed(new_tree(spark, sf_dir)), exclude=["moved/", "inbox/"]
    )
    return feed.select("change_type", "a_path", "b_path")


EDITED_TEXT = (
    "CASE doc_id % 4 WHEN 0 THEN text || '#v2' WHEN 1 THEN substr(text, 1, CAST(floor(length(text) * 0.75) AS INT)) "
    "WHEN 2 THEN substr(text, CAST(floor(length(text) * 0.6) AS INT) + 1) ELSE text END"
)
_LIKELIEST = "likeness DESC, renamed, a_path, b_path"


def _taken_sql(rounds: int = 8) -> str:
    """Pairs in descending order of likeness: those that are the best of both their files, round by round."""
    out = []
    for i in range(rounds):
        out.append(
            f"""ranked{i} AS (
  SELECT *, row_number() OVER (PARTITION BY a_path ORDER BY {_LIKELIEST}) AS ra, row_number() OVER (PARTITION BY b_path ORDER BY {_LIKELIEST}) AS rb
  FROM pairs{i}),
taken{i} AS MATERIALIZED (SELECT a_path, b_path FROM ranked{i} WHERE ra = 1 AND rb = 1),
pairs{i + 1} AS MATERIALIZED (
  SELECT * FROM pairs{i} WHERE a_path NOT IN (SELECT a_path FROM taken{i}) AND b_path NOT IN (SELECT b_path FROM taken{i}))"""
        )
    every = " UNION ALL ".join(f"SELECT * FROM taken{i}" for i in range(rounds))
    return ",\n".join(out) + f",\ntaken AS ({every})"


@query(rf"""
WITH old_tree AS (SELECT doc_id, source, lang, {OLD_PATH} AS path, text FROM documents),
new_tree AS (SELECT doc_id, source, lang, {NEW_PATH} AS path, {EDITED_TEXT} AS text FROM documents),
{diff_sql(scoped=True)},
files AS (
  SELECT 'went' AS side, o.source, o.lang, o.path, o.text FROM diff JOIN old_tree o ON o.path = a_path WHERE change_type = 'D'
  UNION ALL
  SELECT 'came', n.source, n.lang, n.path, n.text FROM diff JOIN new_tree n ON n.path = b_path WHERE change_type = 'A'),
lines AS (SELECT side, source, lang, path, unnest(regexp_extract_all(text, '[^
]{{0,63}}
|[^
]{{1,64}}')) AS line FROM files),
weights AS (SELECT side, source, lang, path, line, sum(length(line)) AS w FROM lines GROUP BY ALL),
sizes AS (SELECT side, path, sum(w) AS size FROM weights GROUP BY ALL),
shared AS (
  SELECT a.path AS a_path, b.path AS b_path, sum(least(a.w, b.w)) AS w
  FROM weights a JOIN weights b ON a.side = 'went' AND b.side = 'came' AND a.source = b.source AND a.lang = b.lang AND a.line = b.line
  GROUP BY ALL),
pairs0 AS (
  SELECT a_path, b_path, list_last(string_split(a_path, '/')) <> list_last(string_split(b_path, '/')) AS renamed,
    CAST(w AS DOUBLE) / CAST(greatest(a.size, b.size) AS DOUBLE) AS likeness
  FROM shared JOIN sizes a ON a.side = 'went' AND a.path = a_path JOIN sizes b ON b.side = 'came' AND b.path = b_path
  WHERE likeness >= 0.5),
{_taken_sql()}
SELECT change_type, a_path, b_path, hash FROM diff
WHERE NOT (change_type = 'D' AND a_path IN (SELECT a_path FROM taken)) AND NOT (change_type = 'A' AND b_path IN (SELECT b_path FROM taken))
UNION ALL
SELECT 'R', t.a_path, t.b_path, d.hash FROM taken t JOIN diff d ON d.change_type = 'A' AND d.b_path = t.b_path
""")
def rename_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that moved and were edited are renames where half of the larger version is in both."""
    old = old_tree(spark, sf_dir)
    new = table(spark, sf_dir, "documents").selectExpr(*NAMES, f"{NEW_PATH} AS path", f"{EDITED_TEXT} AS text")
    feed = cut(diff_trees(hashed(old), hashed(new), scope=SCOPE), "feed")
    return pair_edited(feed, old, new, SCOPE, content="text").select("change_type", "a_path", "b_path", "hash")


def scoped_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of all sources at once; a file never becomes a rename of another source's file."""
    feed = diff_trees(hashed(old_tree(spark, sf_dir)), hashed(new_tree(spark, sf_dir)), scope=SCOPE)
    return cut(feed, "feed")


RESOLVED_SQL = f"""
{TREES_SQL}, {diff_sql(scoped=True)}, {INDEX_SQL},
looked AS (
  SELECT d.change_type, d.a_path, d.b_path,
         'ns_' || split_part(coalesce(b_path, a_path), '/', 1) AS owner,
         'idx-' || split_part(coalesce(b_path, a_path), '/', 2) AS index_name,
         (SELECT min(i.doc_key) FROM old_index i
          WHERE i.source_uri = d.a_path AND i.owner = 'ns_' || split_part(coalesce(b_path, a_path), '/', 1)) AS known
  FROM diff d),
resolved AS (
  SELECT change_type, a_path, b_path, owner, index_name,
         CASE WHEN change_type = 'D' THEN 'delete' WHEN known IS NOT NULL THEN 'update' ELSE 'create' END AS action,
         coalesce(known, sha256(index_name || chr(1) || owner || chr(1) || b_path)) AS doc_key
  FROM looked WHERE NOT (change_type = 'D' AND known IS NULL))
"""


@query(f"WITH {RESOLVED_SQL} SELECT owner, change_type, a_path, b_path, action, doc_key AS doc_id FROM resolved")
def doc_id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = resolve_doc_ids(scoped_feed(spark, sf_dir), old_index(spark, sf_dir))
    return resolved.select("owner", "change_type", "a_path", "b_path", "action", "doc_id")


def apply_feed(spark: SparkSession, sf_dir: str, index: DataFrame) -> DataFrame:
    """The index once the changes from the old to the new tree are applied."""
    resolved = cut(resolve_doc_ids(scoped_feed(spark, sf_dir), index), "resolved")
    files = changed_files(new_tree(spark, sf_dir), resolved, SCOPE)
    return apply_to_index(index, cut(index_of(files), "upserts"), deleted_ids(resolved))


@query(f"""
WITH {RESOLVED_SQL}
SELECT doc_key AS doc_id, owner, source_uri, 'full' AS change_type, language, md5(text) AS text_hash
FROM old_index WHERE doc_key NOT IN (SELECT doc_key FROM resolved)
UNION ALL
SELECT r.doc_key, r.owner, r.b_path,
       CASE WHEN r.action = 'create' THEN 'added' WHEN r.change_type = 'R' THEN 'renamed' ELSE 'modified' END,
       CASE n.doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'markdown' WHEN 3 THEN 'go' END, md5(n.text)
FROM resolved r JOIN new_tree n ON n.path = r.b_path WHERE r.action <> 'delete'
""")
def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_feed(spark, sf_dir, old_index(spark, sf_dir)).select(
        "doc_id", "owner", "source_uri", "change_type", "language", F.md5("text").alias("text_hash")
    )


@query("""
SELECT count(*) AS n_full, count(*) AS n_incremental, CAST(0 AS BIGINT) AS n_only_full, CAST(0 AS BIGINT) AS n_only_incremental
FROM documents
""")
def full_vs_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old index plus diff holds the same texts under the same paths as a full run on the new tree."""
    incremental = apply_feed(spark, sf_dir, index_of(old_tree(spark, sf_dir)))
    full = index_of(new_tree(spark, sf_dir))

    def keyed(df: DataFrame, side: str) -> DataFrame:
        return df.select("index_name", "owner", "source_uri", F.md5("text").alias("text_hash"), F.lit(side).alias("side"))

    both = keyed(full, "full").unionByName(keyed(incremental, "incremental"))
    pairs = both.groupBy("index_name", "owner", "source_uri", "text_hash").agg(
        F.count_if(F.col("side") == "full").alias("f"),
        F.count_if(F.col("side") == "incremental").alias("i"),
    )
    return pairs.agg(
        F.sum("f").alias("n_full"),
        F.sum("i").alias("n_incremental"),
        F.count_if(F.col("i") == 0).alias("n_only_full"),
        F.count_if(F.col("f") == 0).alias("n_only_incremental"),
    )


@query(f"""
WITH {TREES_SQL}
SELECT sha256('all' || chr(1) || 'ns_' || source || chr(1) || path) AS doc_id, path,
  md5(text) AS text_hash, CASE WHEN doc_id % 4 <> 2 THEN 'code' END AS split_type,
  CAST(8 + CASE WHEN doc_id % 4 <> 2 THEN 2 ELSE 0 END AS BIGINT) AS n_keys
FROM new_tree
""")
def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File documents with all their metadata: absent keys are left out, not null."""
    documents = file_documents(
        with_file_type(new_tree(spark, sf_dir)),
        index_name="all",
        owner=F.col("owner"),
        run_ts=run_ts(),
        repository="docs",
        branch="main",
        commit="v2",
    )
    return documents.select(
        "doc_id",
        F.col("metadata")["file_path"].alias("path"),
        F.md5("text").alias("text_hash"),
        F.col("metadata")["split_type"].alias("split_type"),
        F.size("metadata").cast("long").alias("n_keys"),
    )



NEGATED = ("*.md", "inbox/", "moved/", "!/src3/**/*.md", "!/src4/**/moved/*.go", "!/src5/**/moved/")
NEGATED_KEPT = (
    "(path NOT LIKE '%.md' OR path LIKE 'src3/%') AND path NOT LIKE '%/inbox/%' AND (path NOT LIKE '%/moved/%' OR path LIKE 'src5/%')"
)


@query(f"""
WITH {TREES_SQL}
SELECT 'ns_' || source AS owner, path AS source_uri, md5(text) AS text_hash FROM new_tree
WHERE CASE WHEN source IN ('src1', 'src2', 'src3', 'src4', 'src5') THEN {NEGATED_KEPT} ELSE path LIKE '%.go' AND path NOT LIKE '%/moved/%' END
""")
def sync_ordered_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with ordered rules (what ``!`` brings back stays out below an excluded folder) and with plain ones, in one job: in full, then by changes, two of them after a lost checkpoint."""
    landed = scratch_path(spark, "captures")
    for version, tree in (("v1", old_tree(spark, sf_dir)), ("v2", new_tree(spark, sf_dir))):
        land_snapshot(tree.select("owner", "path", F.col("text").cast("binary").alias("content")), landed, version)
    captures = spark.read.parquet(landed)
    owners = old_tree(spark, sf_dir).select("owner", "source").distinct()
    first = F.col("source").isin("src1", "src2", "src3", "src4", "src5")
    about = {"index_name": F.lit("all"), "repository": F.lit("docs"), "branch": F.lit("main"), "version": F.lit("v1"), "checkpoint": F.lit(None).cast("string")}
    specs = owners.where(first).withColumns(about | path_columns(exclude=NEGATED)).unionByName(
        owners.where(~first).withColumns(about | path_columns(include=["*.go"], exclude=["moved/"]))
    )
    specs = cut(specs, "registry")
    index = IndexTable(spark, scratch_path(spark, "index"))
    sync_all(index, captures, specs.drop("source"), run_ts())
    lost = F.when(F.col("source").isin("src2", "src7"), F.lit("lost")).otherwise(F.lit("v1"))
    sync_all(index, captures, specs.withColumns({"version": F.lit("v2"), "checkpoint": lost}).drop("source"), run_ts())
    return index.read().select("owner", "source_uri", F.md5("text").alias("text_hash"))


FULL_AGAIN = "CASE WHEN source IN ('src3', 'src8') THEN NULL WHEN source = 'src5' THEN 'lost' ELSE 'v1' END"
NO_TEXT_FILES = "path NOT LIKE '%.txt'"


@query(f"""
WITH {TREES_SQL}, {diff_sql(NO_TEXT_FILES, scoped=True)}
SELECT n.owner, n.path AS source_uri, md5(n.text) AS text_hash,
  CASE WHEN {FULL_AGAIN} IS DISTINCT FROM 'v1' OR d.change_type IS NULL THEN 'full'
       WHEN d.change_type = 'A' THEN 'added' WHEN d.change_type = 'M' THEN 'modified' ELSE 'renamed' END AS change_type
FROM (SELECT *, 'ns_' || source AS owner FROM new_tree WHERE {NO_TEXT_FILES}) n
LEFT JOIN diff d ON d.b_path = n.path
""")
def sync_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources in one job, twice: first in full, then by changes where a checkpoint is known."""
    landed = scratch_path(spark, "captures")
    for version, tree in (("v1", old_tree(spark, sf_dir)), ("v2", new_tree(spark, sf_dir))):
        files = tree.select("owner", "index_name", "path", F.col("text").cast("binary").alias("content"))
        land_snapshot(files, landed, version)
    captures = spark.read.parquet(landed)
    _, exclude = path_rules(exclude=["*.txt"])
    # a source's index here depends on its files' language, so each of its parts is a source
    names = F.concat_ws("/", "owner", "index_name")
    captures = captures.withColumn("owner", names).drop("index_name")
    specs = old_tree(spark, sf_dir).groupBy("source", "owner", "index_name").agg(F.count("*").alias("n"))
    specs = specs.select(
        names.alias("owner"),
        "index_name",
        F.lit("docs").alias("repository"),
        F.lit("main").alias("branch"),
        F.lit("v1").alias("version"),
        F.lit(None).cast("string").alias("checkpoint"),
        F.lit(None).cast("string").alias("include_re"),
        F.lit(exclude).alias("exclude_re"),
        F.expr(FULL_AGAIN).alias("next_checkpoint"),
    )
    specs = cut(specs, "registry")
    index = IndexTable(spark, scratch_path(spark, "index"))
    sync_all(index, captures, specs.drop("next_checkpoint"), run_ts())
    again = specs.withColumn("version", F.lit("v2")).withColumn("checkpoint", F.col("next_checkpoint"))
    sync_all(index, captures, again.drop("next_checkpoint"), run_ts())
    return index.read().select(
        F.substring_index("owner", "/", 1).alias("owner"),
        "source_uri",
        F.md5("text").alias("text_hash"),
        "change_type",
    )
