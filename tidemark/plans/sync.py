"""One run of a source: files in full or by changes, captured URLs, database rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import filter_paths, with_file_type
from ..operators.changes import changed_files, deleted_ids, resolve_doc_ids
from ..operators.content import extract_text, with_any_charset
from ..operators.diff import snapshot_diff, with_hash
from ..functions.records import rows_to_text
from ..functions.urls import url_path
from ..operators.likeness import pair_edited
from ..operators.documents import file_documents, position_key, row_documents, url_documents
from ..operators.pages import assemble_pages, documents_without_text
from ..operators.sinks import checked, error_rows
from ..session import cut
from ..sources.captures import capture_error
from ..sources.database import high_water_mark, run_query
from ..sources.trees import MAX_FILE_SIZE, read_snapshot, scan_mode
from .index_table import IndexTable


@dataclass(frozen=True)
class FileSource:
    owner: str
    index_name: str
    repository: str
    branch: str = "main"
    include: Sequence[str] = field(default_factory=tuple)
    exclude: Sequence[str] = field(default_factory=tuple)
    mode: str = "permissive"
    #: Likeness from which a file that moved and was edited keeps its document (``operators.likeness``); None: equal content only.
    rename_likeness: float | None = None


def read_files(files: DataFrame, source: FileSource) -> DataFrame:
    """``(path, content)`` with ``text`` or ``error``: filter, type, route, decode. No shuffle."""
    return extract_text(with_file_type(filter_paths(files, source.include, source.exclude)))


def documents_of(read: DataFrame, source: FileSource, commit: str, run_ts: Column) -> DataFrame:
    """Documents from the files that ``read_files`` gives.

    Files that come with ``doc_id`` and ``change_label`` keep them.
    """
    readable = checked(read, source.mode)
    changed = "change_label" in read.columns
    return file_documents(
        readable,
        index_name=source.index_name,
        owner=source.owner,
        run_ts=run_ts,
        repository=source.repository,
        branch=source.branch,
        commit=commit,
        change_type=F.col("change_label") if changed else "full",
        doc_id=F.col("doc_id") if changed else None,
    )


def plan_changes(
    old: DataFrame, new: DataFrame, index: DataFrame, source: FileSource, version: str = ""
) -> DataFrame:
    """The change feed of an incremental run with the documents it concerns, written once."""
    feed = snapshot_diff(with_hash(old), with_hash(new), source.include, source.exclude)
    if source.rename_likeness is not None:
        feed = pair_edited(cut(feed, "feed"), old, new, least=source.rename_likeness)
    owned = index.where((F.col("owner") == source.owner) & (F.col("index_name") == source.index_name))
    named = {"owner": F.lit(source.owner), "index_name": F.lit(source.index_name)}
    return cut(resolve_doc_ids(cut(feed.withColumns(named), "feed"), owned, version), "resolved")


def sync_files(
    table: IndexTable,
    captures: DataFrame,
    source: FileSource,
    version: str,
    checkpoint: str | None,
    run_ts: Column,
    pinned: bool = False,
    plan_only: bool = False,
) -> DataFrame:
    """Bring an index to a version of a captures table ``(version, path, content)``.

    A full run takes the place of all the source had in the index. An incremental one compares the
    two versions by path and hash and reads the content of changed files only.

    Returns the error rows ``(owner, unit, message)`` of files that could not be read; they are computed
    when they are used. The caller stores ``version`` as the next checkpoint when there are none, so a failed run is
    repeated. With ``plan_only`` it returns the change feed instead, and writes nothing.
    """
    new = read_snapshot(captures, version)
    mode = scan_mode(captures, version if pinned else None, checkpoint)
    if mode == "full":
        read = read_files(new, source)
        documents = documents_of(read, source, version, run_ts)
        if plan_only:
            return documents.select(
                "owner",
                "index_name",
                F.lit("A").alias("change_type"),
                F.lit(None).cast("string").alias("a_path"),
                F.col("source_uri").alias("b_path"),
                "doc_id",
                F.lit("create").alias("action"),
            )
        mine = new.sparkSession.range(1).select(
            F.lit(source.index_name).alias("index_name"), F.lit(source.owner).alias("owner")
        )
        table.apply(upserts=documents, replaces=mine, n_indexes=1)
        return error_rows(read, "path", source.owner)
    old = read_snapshot(captures, checkpoint)
    resolved = plan_changes(old, new, table.read(), source, version)
    if plan_only:
        return resolved.select(
            "owner", "index_name", "change_type", "a_path", "b_path", "doc_id", "action"
        )
    read = read_files(changed_files(new, resolved), source)
    documents = documents_of(read, source, version, run_ts)
    table.apply(upserts=documents, deletes=deleted_ids(resolved), n_indexes=1)
    return error_rows(read, "path", source.owner)


@dataclass(frozen=True)
class UrlSource:
    owner: str
    index_name: str
    max_size: int = MAX_FILE_SIZE
    mode: str = "permissive"
    ts: str | None = None


def _order(df: DataFrame, ts: str | None) -> DataFrame:
    """Order the rows of one document by a time column, where there is one."""
    return df.withColumn("_seq", F.unix_micros(F.col(ts).cast("timestamp"))) if ts else df


def sync_urls(table: IndexTable, captures: DataFrame, source: UrlSource, run_ts: Column) -> DataFrame:
    """Put captured URLs ``(url, content, content_type)`` into an index; a URL keeps its document.

    Of several captures of a URL the newest by ``source.ts`` stays. A column ``content_length``, the length
    that was declared, is held against the size limit too. Any declared charset Python knows is decoded.

    Returns the error rows ``(owner, unit, message)``; they are computed when they are used, from the
    captures. In ``failfast`` mode the first bad capture ends
    the run and nothing is written.
    """
    landed = captures.withColumn(
        "capture_error",
        capture_error(
            F.col("url"),
            F.col("content"),
            source.max_size,
            F.col("content_length") if "content_length" in captures.columns else None,
        ),
    )
    typed = with_file_type(_order(landed, source.ts).withColumn("_path", url_path(F.col("url"))), "_path")
    read = extract_text(typed, with_any_charset()).withColumn("error", F.coalesce("capture_error", "error"))
    documents = url_documents(
        checked(read, source.mode), index_name=source.index_name, owner=source.owner, run_ts=run_ts
    )
    table.apply(upserts=documents, n_indexes=1)
    return error_rows(read, "url", source.owner)


def sync_pages(
    table: IndexTable, pages: DataFrame, tables: DataFrame | None, source: UrlSource, run_ts: Column
) -> DataFrame:
    """Put page rows ``(doc_id, page_num, text)`` and table rows into an index, one document per ``doc_id``, its address.

    Returns the error rows ``(owner, unit, message)`` of documents without any text.
    """
    whole = assemble_pages(pages, tables).withColumn("url", F.col("doc_id").cast("string")).drop("doc_id")
    typed = with_file_type(whole.withColumn("_path", url_path(F.col("url"))), "_path")
    table.apply(
        upserts=url_documents(typed, index_name=source.index_name, owner=source.owner, run_ts=run_ts), n_indexes=1
    )
    empty = documents_without_text(pages, tables)
    return empty.select(F.lit(source.owner).alias("owner"), "unit", "message")


@dataclass(frozen=True)
class RowSource:
    owner: str
    index_name: str
    initial_query: str
    incremental_query: str | None = None
    key: str | None = None
    ts: str | None = None


def sync_rows(
    spark: SparkSession,
    table: IndexTable,
    source: RowSource,
    last_ts: dt.datetime | None,
    run_ts: Column,
    run_id: str,
) -> dt.datetime | None:
    """Put the rows of a query into an index and return the next checkpoint.

    With a key a row replaces its earlier document, and of several rows with one key the newest by
    ``source.ts`` stays; without a key every run appends. The checkpoint
    is the newest time among the rows that were read, so rows that arrive during the run are
    not lost; it stays where it was when there were none.
    """
    rows = cut(run_query(spark, source.initial_query, source.incremental_query, last_ts), "rows")
    keyed, key = (rows, source.key) if source.key else (position_key(rows, run_id, "_key"), "_key")
    ordered = _order(keyed, source.ts if source.key else None)
    texts = rows_to_text(ordered, exclude=["_key", "_seq"])
    table.apply(
        upserts=row_documents(
            texts, key=key, index_name=source.index_name, owner=source.owner, run_ts=run_ts
        ),
        n_indexes=1,
    )
    newest = high_water_mark(rows, source.ts) if source.ts else None
    return newest or last_ts
