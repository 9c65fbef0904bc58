"""Documents: text with ownership, type, language and source metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_utc
from ..schema import DOCUMENT

SEPARATOR = "\u0001"


def _col(value: Column | str | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("string")


def owner_key(namespace: Column, name: Column) -> Column:
    return F.concat_ws("_", namespace, name)


def document_id(index_name: Column, owner: Column, source_uri: Column) -> Column:
    """The id of a document at its first insert; later changes carry it along."""
    return F.sha2(F.concat_ws(SEPARATOR, index_name, owner, source_uri), 256)


def _present(**entries: Column) -> Column:
    pairs = [x for key, value in entries.items() for x in (F.lit(key), value.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _build(
    df: DataFrame,
    *,
    source_type: str,
    uri: Column,
    index_name: Column | str,
    owner: Column | str,
    change_type: Column | str | None,
    run_ts: Column,
    extra: dict[str, Column],
    doc_id: Column | None = None,
) -> DataFrame:
    """Documents; a column ``_seq`` that orders rows of one document is passed on."""

    def optional(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    index_name, owner, change_type = _col(index_name), _col(owner), _col(change_type)
    metadata = _present(
        owner=owner,
        source_type=F.lit(source_type),
        **extra,
        change_type=change_type,
        timestamp=iso_utc(run_ts),
        language=optional("language"),
        split_type=optional("split_type"),
    )
    return df.where(F.length("text") > 0).select(
        (document_id(index_name, owner, uri) if doc_id is None else doc_id).alias("doc_id"),
        index_name.alias("index_name"),
        owner.alias("owner"),
        F.lit(source_type).alias("source_type"),
        uri.alias("source_uri"),
        change_type.alias("change_type"),
        optional("language").alias("language"),
        optional("split_type").alias("split_type"),
        F.col("text"),
        metadata.alias("metadata"),
        *[c for c in ("_seq",) if c in df.columns],
    )


def file_documents(
    df: DataFrame,
    *,
    index_name: Column | str,
    owner: Column | str,
    run_ts: Column,
    repository: Column | str | None = None,
    branch: Column | str | None = None,
    commit: Column | str | None = None,
    change_type: Column | str = "full",
    doc_id: Column | None = None,
) -> DataFrame:
    """Documents from files (``path, text`` and, where known, ``language, split_type``).

    Files without text give no document. A changed file keeps the ``doc_id`` it had.
    """
    return _build(
        df,
        source_type="git",
        uri=F.col("path"),
        index_name=index_name,
        owner=owner,
        change_type=change_type,
        run_ts=run_ts,
        extra={
            "repository": _col(repository),
            "branch": _col(branch),
            "file_path": F.col("path"),
            "commit": _col(commit),
        },
        doc_id=doc_id,
    )


def url_documents(
    df: DataFrame, *, index_name: Column | str, owner: Column | str, run_ts: Column
) -> DataFrame:
    """Documents from captured URLs (``url, text`` and, where known, ``language, split_type``)."""
    return _build(
        df,
        source_type="url",
        uri=F.col("url"),
        index_name=index_name,
        owner=owner,
        change_type=None,
        run_ts=run_ts,
        extra={"source_url": F.col("url")},
    )


def row_documents(
    df: DataFrame, *, key: str, index_name: Column | str, owner: Column | str, run_ts: Column
) -> DataFrame:
    """Documents from database rows (``text`` and a key column: same key, same document)."""
    return _build(
        df,
        source_type="database",
        uri=F.col(key).cast("string"),
        index_name=index_name,
        owner=owner,
        change_type=None,
        run_ts=run_ts,
        extra={},
    )


def position_key(written: DataFrame, run_id: str, out: str = "row_key") -> DataFrame:
    """A key for rows that have none, so that every run appends: run, file and place in the file.

    The frame must be a plain read of a written table (see ``session.cut``): places in a
    written file do not change, whatever is recomputed, and equal rows still differ. No shuffle.
    """
    place = (F.col("_metadata.file_name"), F.col("_metadata.row_index").cast("string"))
    return written.withColumn(out, F.concat_ws("#", F.lit(run_id), *place))


def empty_index(spark) -> DataFrame:
    return spark.createDataFrame([], DOCUMENT)
