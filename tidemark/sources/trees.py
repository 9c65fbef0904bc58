"""File trees and versioned snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import keep_path
from ..operators.diff import with_hash
from ..operators.tree_digests import land_digests

#: The usual limit for captured URLs; files of a tree have none unless one is set.
MAX_FILE_SIZE = 100 * 1024 * 1024


def _relative(uri: Column, root: str) -> Column:
    """Path below ``root``. File names arrive percent-encoded in the metadata column."""
    plain = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    base = root.split("://", 1)[-1] if "://" in root else root.removeprefix("file:")
    return F.substring(plain, F.instr(plain, base.rstrip("/") + "/") + len(base.rstrip("/")) + 1, 2**31 - 1)


def read_tree(
    spark: SparkSession,
    root: str,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    max_size: int | None = None,
) -> DataFrame:
    """All files below ``root`` that pass the path filter, and the size limit where one is set.

    Both tests are on file metadata, so Spark drops the other files while it lists them and
    never opens them. The ``.git`` folder is hidden, so the path filter leaves it out.
    ``oversized_files`` gives the error rows of the files that a limit leaves out.
    """
    files, keep = _listed(spark, root, include, exclude)
    small = F.lit(True) if max_size is None else F.col("_metadata.file_size") <= max_size
    return files.where(keep & small).select(
        _relative(F.col("_metadata.file_path"), root).alias("path"),
        "content",
        "length",
        F.col("modificationTime").alias("modified"),
    )


def _listed(
    spark: SparkSession, root: str, include: Sequence[str], exclude: Sequence[str]
) -> tuple[DataFrame, Column]:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files, keep_path(_relative(F.col("_metadata.file_path"), root), include, exclude)


def oversized_files(
    spark: SparkSession, root: str, max_size: int, include: Sequence[str] = (), exclude: Sequence[str] = ()
) -> DataFrame:
    """``(unit, message)`` for each file that passes the path filter and is over the limit; none is opened."""
    files, keep = _listed(spark, root, include, exclude)
    return files.where(keep & (F.col("_metadata.file_size") > max_size)).select(
        _relative(F.col("_metadata.file_path"), root).alias("unit"),
        F.lit(f"File too large: exceeds limit of {max_size} bytes").alias("message"),
    )


def land_snapshot(files: DataFrame, root: str, version: str, digests: str | None = None) -> None:
    """Add one version of ``(path, content)`` to a captures table.

    Content hashes are stored alongside, so comparing versions later reads paths and hashes only.
    A version that is landed again replaces itself. Files that name their ``owner`` are filed by owner and version,
    so sources may use the same version names: only the owners among the files are replaced.

    With ``digests``, a folder of its own, the digests of the version's folders are written there for ``tree_digests.tree_diff``;
    the files must be those of one tree.
    """
    hashed = with_hash(files)
    if digests is not None:
        land_digests(hashed.select("path", "hash", "size"), digests, version)
    if "owner" not in files.columns:
        hashed.write.mode("overwrite").parquet(f"{root}/version={version}")
        return
    by_owner = hashed.withColumn("version", F.lit(version)).write.partitionBy("owner", "version")
    by_owner.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)


def read_snapshot(captures: DataFrame, version: str) -> DataFrame:
    """One version out of a captures table that is partitioned by ``version``."""
    return captures.where(F.col("version") == version)


def has_version(captures: DataFrame, version: str | None) -> bool:
    """Whether the table holds the version; reads one row at most."""
    return bool(version) and not read_snapshot(captures, version).limit(1).isEmpty()


def scan_mode(captures: DataFrame, pinned: str | None, checkpoint: str | None) -> str:
    """``full`` for a pinned version, no checkpoint or a lost one; ``diff`` otherwise."""
    if pinned or not checkpoint:
        return "full"
    return "diff" if has_version(captures, checkpoint) else "full"
