"""One job for all file sources of a registry, whatever their number.

Sources differ in size by orders of magnitude; one job over all of them keeps the cluster busy where
a job per source would wait for the biggest. Joins of files with files have the path in their keys, so a
source with a third of all files is spread like any other. The other joins bring a source's row of the registry to its files;
the registry is a written table, so Spark knows its size and broadcasts it while it is small. Sources in need of
a full run go from scan to index without a join by path: their content is never shuffled before it is written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_binary_name, is_hidden, with_file_type
from ..functions.patterns import RULES, compile_patterns, matches_rules, parse_patterns, rule_list
from ..operators.changes import deleted_ids, likely_rows, resolve_doc_ids
from ..operators.content import extract_text
from ..operators.diff import snapshot_diff, with_hash
from ..operators.documents import document_id, file_documents
from ..operators.sinks import good_rows
from ..session import cut
from .index_table import IndexTable

_SCOPE = ("index_name", "owner")
_NOTHING = "(?!)"
_PATTERNS = ("include_re", "include_rules", "exclude_re", "exclude_rules")


def path_rules(include: Sequence[str] = (), exclude: Sequence[str] = ()) -> tuple[str | None, str | None]:
    """Pattern lists as the ``include_re`` and ``exclude_re`` of a spec row; no ``!`` patterns here, see ``path_columns``."""
    return (
        (compile_patterns(include) or _NOTHING) if include else None,
        compile_patterns(exclude) if exclude else None,
    )


def path_columns(include: Sequence[str] = (), exclude: Sequence[str] = ()) -> dict[str, Column]:
    """Pattern lists as the four columns of a spec row. A list with ``!`` becomes ordered rules, any other one expression, which is faster."""
    out = {}
    for name, patterns in (("include", include), ("exclude", exclude)):
        ordered = any(p.negated for p in parse_patterns(patterns))
        one = None if ordered or not patterns else compile_patterns(patterns)
        if name == "include" and patterns and not ordered and one is None:
            one = _NOTHING
        rules = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("body", "negated", "folder"), r, strict=True)]) for r in rule_list(patterns)])
        out[f"{name}_re"] = F.lit(one).cast("string")
        out[f"{name}_rules"] = (rules if ordered else F.lit(None)).cast(RULES)
    return out


def _with_rules(specs: DataFrame) -> DataFrame:
    """Specs with all four columns; those that are absent select nothing out."""
    absent = {c: F.lit(None).cast("string" if c.endswith("_re") else RULES) for c in _PATTERNS if c not in specs.columns}
    return specs.withColumns(absent) if absent else specs


def _kept() -> Column:
    path = F.col("path")
    included = F.col("include_re").isNull() | F.rlike(path, F.col("include_re"))
    excluded = F.col("exclude_re").isNotNull() & F.rlike(path, F.col("exclude_re"))
    # ordered rules only where a row has them
    included = included & F.when(F.col("include_rules").isNull(), F.lit(True)).otherwise(matches_rules(path, F.col("include_rules")))
    excluded = F.coalesce(excluded, F.lit(False)) | F.when(F.col("exclude_rules").isNull(), F.lit(False)).otherwise(matches_rules(path, F.col("exclude_rules")))
    return ~is_hidden(path) & ~is_binary_name(path) & included & ~excluded


def scan_modes(specs: DataFrame, captures: DataFrame) -> DataFrame:
    """Specs with ``full``: true without a checkpoint or when its version is no longer there."""
    wanted = specs.where("checkpoint IS NOT NULL").select("owner", F.col("checkpoint").alias("version")).distinct()
    found = captures.select("owner", "version").join(wanted, ["owner", "version"], "left_semi").distinct()
    there = found.select("owner", F.col("version").alias("checkpoint"), F.lit(True).alias("_there"))
    return specs.join(there, ["owner", "checkpoint"], "left").withColumn("full", F.col("_there").isNull()).drop("_there")


def _files(captures: DataFrame, specs: DataFrame, version: str) -> DataFrame:
    wanted = specs.select(*_SCOPE, *_PATTERNS, F.col(version).alias("version"))
    return captures.join(wanted, ["owner", "version"]).where(_kept()).drop(*_PATTERNS)


def sync_all(
    table: IndexTable, captures: DataFrame, specs: DataFrame, run_ts: Column
) -> tuple[DataFrame, DataFrame]:
    """Bring every source of a registry to its version.

    Returns ``(owner, full, checkpoint, n_errors)`` per source and the error rows ``(owner, index_name, unit, message)``.
    The checkpoint of a source with errors stays what it was.

    ``captures`` has ``owner, version, path, content`` (and ``hash, size`` when landed with them).
    ``specs`` has one row per source: ``owner, index_name, repository, branch, version, checkpoint,
    include_re, exclude_re``, or ``include_rules, exclude_rules`` for lists with ``!`` (``path_columns`` gives all four). Sources in need of a full run are replaced; the others are compared with their
    checkpoint. It is one commit for all.
    """
    planned = cut(scan_modes(_with_rules(specs), captures), "specs")
    captures = with_hash(captures)
    whole, partly = planned.where("full"), planned.where(~F.col("full"))
    about = planned.select(*_SCOPE, "version", "repository", "branch")

    in_full = _files(captures, whole, "version").join(about, [*_SCOPE, "version"])
    feed = cut(
        snapshot_diff(_files(captures, partly, "checkpoint"), _files(captures, partly, "version"), scope=_SCOPE), "feed"
    )
    known = table.read().join(partly.select(*_SCOPE), list(_SCOPE), "left_semi")
    versions = planned.select(*_SCOPE, F.col("version").alias("_made_by"))
    resolved = cut(
        resolve_doc_ids(feed.join(versions, list(_SCOPE)), known, F.col("_made_by")).drop("_made_by"), "resolved"
    )
    # all that is known about a changed file first, then one join with the content
    wanted = (
        resolved.where(F.col("action") != "delete")
        .select(*_SCOPE, F.col("b_path").alias("path"), "doc_id", "change_label")
        .join(about, list(_SCOPE))
    )
    # versions that are compared, by the registry, so that folders of others are not opened; of those the changed files
    versioned = captures.join(partly.select("owner", "version"), ["owner", "version"], "left_semi")
    keys = ["owner", "version", "path"]
    changed = likely_rows(versioned, wanted, keys).join(wanted, keys)
    first_id = document_id(F.col("index_name"), F.col("owner"), F.col("path"))
    files = in_full.withColumns({"doc_id": first_id, "change_label": F.lit("full")}).unionByName(changed)
    read = extract_text(with_file_type(files))
    documents = file_documents(
        good_rows(read),
        index_name=F.col("index_name"),
        owner=F.col("owner"),
        run_ts=run_ts,
        repository=F.col("repository"),
        branch=F.col("branch"),
        commit=F.col("version"),
        change_type=F.col("change_label"),
        doc_id=F.col("doc_id"),
    )
    n_indexes = planned.select("index_name").distinct().count()
    table.apply(upserts=documents, deletes=deleted_ids(resolved), replaces=whole, n_indexes=n_indexes)

    failed = read.where(F.col("error").isNotNull())
    errors = cut(
        failed.select(*_SCOPE, F.col("path").alias("unit"), F.col("error").alias("message")).select(
            "owner", "index_name", "unit", "message"
        ),
        "errors",
    )
    counts = errors.groupBy(*_SCOPE).agg(F.count("*").alias("n_errors"))
    done = planned.join(counts, list(_SCOPE), "left").withColumn("n_errors", F.coalesce("n_errors", F.lit(0).cast("long")))
    reached = F.when(F.col("n_errors") == 0, F.col("version")).otherwise(F.col("checkpoint"))
    return done.select("owner", "full", reached.alias("checkpoint"), "n_errors"), errors
