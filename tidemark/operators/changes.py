"""From a change feed to the next state of an index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .documents import SEPARATOR, document_id


_ID = ["index_name", "doc_id"]
_URI = ["index_name", "owner", "source_uri"]


def first_match(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(index_name, owner, source_uri, doc_id)`` for wanted keys, one id per key.

    The wanted keys reduce the index before anything is grouped: when they are few, Spark broadcasts
    them and the index is not shuffled at all. The smallest id wins where copies exist.
    """
    return (
        index.select(*_URI, "doc_id")
        .join(wanted.select(*_URI), _URI, "left_semi")
        .groupBy(*_URI)
        .agg(F.min("doc_id").alias("doc_id"))
    )


def resolve_doc_ids(changes: DataFrame, index: DataFrame, version: Column | str = "") -> DataFrame:
    """Find the documents that changes are about.

    Takes ``(owner, index_name, change_type, a_path, b_path)``; gives them back with ``action``
    (create, update, delete), the ``doc_id`` it applies to and the document's ``change_label``.
    A modified or renamed file that the index does not know becomes a new document; a deleted
    one is left out. The changes are used more than once, so pass a written feed.

    A document carries its id along when it moves, so the id of a new file may be taken by one
    that was at its path before; the new one then gets an id that also depends on ``version``, the
    version that creates it. A repeat of the run gives the same ids: a file whose document is already at
    its path keeps it.

    The index is read once: its rows that the changes may mean are written, and all lookups are among these.
    """
    keyed = changes.withColumn("source_uri", F.coalesce("a_path", "b_path"))
    renamed = keyed.where("change_type = 'R'").withColumn("source_uri", F.col("b_path"))
    first_id = document_id(F.col("index_name"), F.col("owner"), F.col("b_path"))
    wanted = keyed.where(~F.col("change_type").isin("D")).select("index_name", first_id.alias("doc_id"))
    uris = keyed.select(*_URI).unionByName(renamed.select(*_URI))
    meant = cut(likely_rows_of_any(index.select(*_URI, "doc_id"), [(uris, _URI), (wanted, _ID)]), "meant")
    found = first_match(meant, keyed)
    # a rename that was applied before: its document is at the new path already
    moved = first_match(meant, renamed).withColumnsRenamed({"source_uri": "b_path", "doc_id": "_moved"})
    known = F.col("doc_id").isNotNull() & (F.col("change_type") != "A")
    action = (
        F.when(F.col("change_type") == "D", F.when(known, F.lit("delete")))
        .when(known, F.lit("update"))
        .otherwise(F.lit("create"))
    )
    label = F.when(
        F.col("action") == "update",
        F.when(F.col("change_type") == "R", F.lit("renamed")).otherwise(F.lit("modified")),
    ).when(F.col("action") == "create", F.lit("added"))
    with_id = (
        keyed.join(found, _URI, "left")
        .join(moved.withColumn("change_type", F.lit("R")), [*_URI[:2], "b_path", "change_type"], "left")
        .withColumn("doc_id", F.coalesce("doc_id", "_moved"))
        .withColumn("action", action)
        .where(F.col("action").isNotNull())
        .withColumn("change_label", label)
        .withColumn("_new", (F.col("action") == "create") & F.col("doc_id").isNull())
        .withColumn("doc_id", F.coalesce("doc_id", first_id))
        .drop("source_uri", "_moved")
    )
    taken = (
        meant.join(wanted, _ID, "left_semi")
        .where(F.col("doc_id").isNotNull())
        .select(*_ID, F.lit(True).alias("_taken"))
        .distinct()
    )
    made_by = F.lit(version) if isinstance(version, str) else version
    other_id = F.sha2(F.concat_ws(SEPARATOR, "doc_id", made_by, F.lit("again")), 256)
    clash = F.col("_new") & F.col("_taken").isNotNull()
    return (
        with_id.join(taken, _ID, "left")
        .withColumn("doc_id", F.when(clash, other_id).otherwise(F.col("doc_id")))
        .select(*changes.columns, "action", "change_label", "doc_id")
    )


#: Bits of the mask that finds the content of changed files; 64 share a row, so that it has half a million rows at most.
MASK_BITS = 2**25


def _place(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(MASK_BITS))


def _masks(wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(_slot, _mask)``: a bit per hash of the wanted keys, 64 to a row."""
    bits = wanted.select(_place(keys).alias("_place")).groupBy(F.shiftright("_place", 6).alias("_slot"))
    return bits.agg(F.bit_or(F.expr("shiftleft(1L, CAST(_place & 63 AS INT))")).alias("_mask"))


def likely_rows(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys are among the wanted ones, and a few whose hashes meet one.

    For wide rows before a join with many wanted keys, so that the others are not shuffled. A bit per hash, 4 MB at
    most, is broadcast to the scan; the more keys are wanted the more rows get through, never fewer.
    """
    hit = (F.shiftright("_at", 6) == F.col("_slot")) & (F.expr("_mask & shiftleft(1L, CAST(_at & 63 AS INT))") != 0)
    return rows.withColumn("_at", _place(keys)).join(F.broadcast(_masks(wanted, keys)), hit, "left_semi").drop("_at")


def likely_rows_of_any(rows: DataFrame, wanted: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """``likely_rows`` by several ``(wanted, keys)`` in one pass: the rows that may be among the wanted ones of any."""
    marked, likely = rows, F.lit(False)
    for i, (frame, keys) in enumerate(wanted):
        masks = F.broadcast(_masks(frame, keys).withColumnsRenamed({"_slot": f"_slot{i}", "_mask": f"_mask{i}"}))
        marked = marked.withColumn(f"_at{i}", _place(keys)).join(masks, F.shiftright(f"_at{i}", 6) == F.col(f"_slot{i}"), "left")
        bit = F.expr(f"_mask{i} & shiftleft(1L, CAST(_at{i} & 63 AS INT))")
        likely = likely | F.coalesce(bit != 0, F.lit(False))
    return marked.where(likely).select(*rows.columns)


def changed_files(files: DataFrame, resolved: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The files behind creates and updates, with ``doc_id`` and ``change_label`` alongside.

    One join brings id and label to the content; when few files changed, Spark broadcasts the
    changes and the content is not shuffled. Otherwise only content of changed files is.
    """
    wanted = resolved.where(F.col("action") != "delete").select(
        *scope, F.col("b_path").alias("path"), "doc_id", "change_label"
    )
    keys = [*scope, "path"]
    return likely_rows(files, wanted, keys).join(wanted, keys)


def deleted_ids(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("action") == "delete").select("index_name", "doc_id")


def apply_changes(index: DataFrame, upserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """The index after creates, updates and deletes, in one anti join.

    Applying the same changes again gives the same index. The upserts are used twice: pass
    written ones (see ``session.cut``) when they are costly to compute.
    """
    touched = upserts.select(*_ID).unionByName(deletes.select(*_ID))
    return index.join(touched, _ID, "left_anti").unionByName(upserts)


def append_documents(index: DataFrame, documents: DataFrame) -> DataFrame:
    return index.unionByName(documents)


def delete_documents(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select(*_ID), _ID, "left_anti")


# metadata keys that have a column of their own, and those that share one by type of source
_PROMOTED = ("owner", "source_type", "change_type", "language", "split_type")
_SOURCE_URI = {"file_path": "git", "source_url": "url"}


def metadata_is(key: str, value: str) -> Column:
    """Equality on a metadata key, on columns that Parquet can filter where there are some."""
    if key in _PROMOTED:
        return F.col(key) == value
    if key in _SOURCE_URI:
        return (F.col("source_uri") == value) & (F.col("source_type") == _SOURCE_URI[key])
    return F.col("metadata")[key] == value


def list_documents(
    index: DataFrame,
    index_name: str | None = None,
    metadata_filter: dict[str, str] | None = None,
    limit: int = 10,
    offset: int = 0,
    after: str | None = None,
) -> DataFrame:
    """One page of documents in id order.

    ``after`` continues behind the last id of the page before; that stays cheap on any page,
    while ``offset`` has to rank all rows in front of it.
    """
    page = select_documents(index, index_name, metadata_filter)
    if after is not None:
        page = page.where(F.col("doc_id") > after)
    return page.orderBy("doc_id").offset(offset).limit(limit)


def documents_page(
    index: DataFrame,
    index_name: str | None = None,
    metadata_filter: dict[str, str] | None = None,
    limit: int = 10,
    offset: int = 0,
    after: str | None = None,
) -> DataFrame:
    """One page of documents with ``total_items``, the number of all that the filter selects."""
    total = select_documents(index, index_name, metadata_filter).agg(F.count("*")).scalar()
    return list_documents(index, index_name, metadata_filter, limit, offset, after).withColumn("total_items", total)


def select_documents(
    index: DataFrame, index_name: str | None = None, metadata_filter: dict[str, str] | None = None
) -> DataFrame:
    rows = index if index_name is None else index.where(F.col("index_name") == index_name)
    for key, value in (metadata_filter or {}).items():
        rows = rows.where(metadata_is(key, value))
    return rows


def count_documents(
    index: DataFrame, index_name: str | None = None, metadata_filter: dict[str, str] | None = None
) -> int:
    """How many documents the filter selects, without reading their text."""
    return select_documents(index, index_name, metadata_filter).count()


def index_counts(index: DataFrame) -> DataFrame:
    """Documents per index and owner."""
    return index.groupBy("index_name", "owner").agg(F.count("*").alias("n_documents"))


def list_indexes(index: DataFrame) -> DataFrame:
    return index.select("index_name").distinct()
