"""Digests per folder, so that two versions of a tree are compared only where they differ.

A folder's digest stands for all files below it, its own digest for the files right in it: their number, and the sums of two
hashes of each path and content. Sums need no order, so every folder's digest comes out of one aggregation that each task begins on
its own files, and no folder's files ever meet in one task.

``land_digests`` writes the digests of a version by depth and by bucket of the parent folder, and the file list by bucket of the
folder. ``tree_diff`` goes down from the root: at each depth it opens only the buckets of folders that differ, and at the end only
those of folders whose own files differ. What it reads follows the change, not the tree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .diff import snapshot_diff

#: Buckets of folders per depth; one that differs is opened as a whole.
BUCKETS = 64
_SUMS = ["n", "sum_1", "sum_2"]
_OWN = ["own_n", "own_1", "own_2"]
_FOLDERS = "folder string, parent string, " + ", ".join(f"{c} {'bigint' if c.endswith('n') else 'decimal(38,0)'}" for c in _SUMS + _OWN)
_FILES = "path string, folder string, hash string, size bigint"


def folder_of(path: Column) -> Column:
    """The folder that a path is in; the root is the empty string."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def folder_digests(files: DataFrame) -> DataFrame:
    """``(folder, parent, depth, n, sum_1, sum_2, own_n, own_1, own_2)`` for every folder of ``(path, hash)``, the root included."""
    parts = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda i: F.struct(
            i.alias("depth"),
            F.array_join(F.slice(parts, 1, i), "/").alias("folder"),
            F.when(i > 0, F.array_join(F.slice(parts, 1, F.greatest(i - 1, F.lit(0))), "/")).alias("parent"),
            (i == F.size(parts) - 1).alias("own"),
        ),
    )
    one = [F.xxhash64("path", "hash"), F.xxhash64("hash", F.lit("/"), "path")]
    rows = files.select(F.explode(above).alias("_at"), *[h.cast("decimal(38,0)").alias(f"_{k}") for k, h in enumerate(one, 1)])
    # sums of 64-bit hashes: exact up to 10 ** 18 files
    own = lambda value: F.sum(F.when(F.col("_at.own"), value).otherwise(0))
    return rows.groupBy("_at.folder", "_at.parent", "_at.depth").agg(
        F.count("*").alias("n"), F.sum("_1").cast("decimal(38,0)").alias("sum_1"), F.sum("_2").cast("decimal(38,0)").alias("sum_2"),
        F.count_if("_at.own").alias("own_n"), own(F.col("_1")).cast("decimal(38,0)").alias("own_1"), own(F.col("_2")).cast("decimal(38,0)").alias("own_2"),
    )


def _bucket(folder: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(folder, F.lit("/"))), F.lit(buckets)).cast("int")


def land_digests(files: DataFrame, root: str, version: str, buckets: int = BUCKETS) -> None:
    """Write the folder digests and the file list of a version of ``(path, hash, size)``. A version that is landed again replaces itself."""
    listed = cut(files.select("path", folder_of(F.col("path")).alias("folder"), "hash", F.col("size").cast("long").alias("size")), "tree")
    folders = folder_digests(listed).withColumn("bucket", _bucket(F.col("parent"), buckets))
    folders.repartition("depth", "bucket").write.mode("overwrite").partitionBy("depth", "bucket").parquet(f"{root}/folders/version={version}")
    # ranges split a folder that holds very many files
    placed = listed.withColumn("bucket", _bucket(F.col("folder"), buckets)).repartitionByRange("bucket", "folder", "path").sortWithinPartitions("bucket", "folder", "path")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/files/version={version}")


def _read(spark: SparkSession, path: str, schema: str, found: DataFrame | None, buckets: int) -> DataFrame:
    """The rows in the buckets of some folders; at most ``buckets`` numbers go to the driver, and other files are not opened."""
    rows = spark.read.schema(f"{schema}, bucket int").parquet(path)
    if found is None:
        return rows
    wanted = [r["bucket"] for r in found.select(_bucket(F.col("folder"), buckets).alias("bucket")).distinct().collect()]
    return rows.where(F.col("bucket").isin(wanted)) if wanted else rows.where(F.lit(False))


def differing_folders(spark: SparkSession, root: str, old: str, new: str, buckets: int = BUCKETS) -> list[DataFrame]:
    """Per depth the folders whose digests differ, ``(folder, own)``, where ``own`` tells whether the files right in them do."""
    out: list[DataFrame] = []
    schema = f"{_FOLDERS}, depth int"
    while True:
        found, sides = out[-1] if out else None, []
        for name, version in (("old", old), ("new", new)):
            rows = _read(spark, f"{root}/folders/version={version}", schema, found, buckets).where(F.col("depth") == len(out))
            if found is not None:
                rows = rows.join(found.select(F.col("folder").alias("parent")), "parent", "left_semi")
            sides.append(rows.select("folder", F.struct(*_SUMS).alias(f"{name}_all"), F.struct(*_OWN).alias(f"{name}_own")))
        both = sides[0].join(sides[1], "folder", "full_outer").where(~F.col("old_all").eqNullSafe(F.col("new_all")))
        none = F.struct(*[F.lit(0).cast("long" if c == "own_n" else "decimal(38,0)").alias(c) for c in _OWN])
        own = F.coalesce("old_own", none) != F.coalesce("new_own", none)
        level = cut(both.select("folder", own.alias("own")), f"differing-{len(out)}")
        if level.isEmpty():
            return out
        out.append(level)


def tree_diff(
    spark: SparkSession, root: str, old: str, new: str, include: Sequence[str] = (), exclude: Sequence[str] = (), buckets: int = BUCKETS
) -> DataFrame:
    """The change feed between two landed versions, equal to ``snapshot_diff`` of their whole file lists."""
    sides = changed_files_of(spark, root, old, new, buckets)
    return snapshot_diff(*sides, include, exclude)


def changed_files_of(spark: SparkSession, root: str, old: str, new: str, buckets: int = BUCKETS) -> list[DataFrame]:
    """The files of both versions in the folders whose own files differ: ``(path, hash, size)``."""
    levels = differing_folders(spark, root, old, new, buckets)
    found = spark.createDataFrame([], "folder string")
    for level in levels:
        found = found.unionByName(level.where("own").select("folder"))
    found, out = cut(found, "changed-folders"), []
    for version in (old, new):
        rows = _read(spark, f"{root}/files/version={version}", _FILES, found, buckets)
        out.append(rows.join(found, "folder", "left_semi").select("path", "hash", "size"))
    return out
