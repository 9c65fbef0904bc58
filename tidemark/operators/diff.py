"""What changed between two snapshots of a tree.

Only path, content hash and size are compared and shuffled; the content itself is joined
back later, for changed paths only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import filter_paths
from ..session import cut as write_cut
from .numbering import number_rows


def with_hash(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``hash`` and ``size``, unless the frame has them already."""
    if {"hash", "size"} <= set(df.columns):
        return df
    return df.withColumn("hash", F.md5(F.col(content).cast("binary"))).withColumn(
        "size", F.octet_length(content)
    )


def path_changes(
    old: DataFrame,
    new: DataFrame,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    scope: Sequence[str] = (),
) -> DataFrame:
    """A, M and D by path: ``(*scope, kind, path, hash, size)``. Unchanged paths are left out.

    The path filter is applied to both snapshots before the join, so a file that moves across
    the filter's border shows up as added or deleted.
    """
    keys = [*scope, "path"]
    before = filter_paths(old, include, exclude).select(
        *keys, F.col("hash").alias("old_hash"), F.col("size").alias("old_size")
    )
    after = filter_paths(new, include, exclude).select(
        *keys, F.col("hash").alias("new_hash"), F.col("size").alias("new_size")
    )
    kind = (
        F.when(F.col("old_hash").isNull(), F.lit("A"))
        .when(F.col("new_hash").isNull(), F.lit("D"))
        .when(F.col("old_hash") != F.col("new_hash"), F.lit("M"))
    )
    return (
        before.join(after, keys, "full_outer")
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            *scope,
            "kind",
            "path",
            F.coalesce("new_hash", "old_hash").alias("hash"),
            F.coalesce("new_size", "old_size").alias("size"),
        )
    )


def pair_renames(changes: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Turn deleted and added files of equal content into renames, one to one.

    The k-th deleted and the k-th added file of a content hash become one R, so many copies
    of one content pair up without comparing each with each. The k's come from sliced
    numbering, so a content that is a third of all files is spread over many tasks. Empty
    files never pair. Only equal content counts; similar content does not.
    """
    movable = F.col("kind").isin("A", "D") & (F.col("size") > 0)
    # only contents that both came and went can pair: their number is small beside that of the changes
    both = (
        changes.where(movable)
        .groupBy(*scope, "hash")
        .agg(F.count_if(F.col("kind") == "A").alias("came"), F.count_if(F.col("kind") == "D").alias("went"))
        .where("came > 0 AND went > 0")
        .select(*scope, "hash", F.lit(True).alias("pairs"))
    )
    marked = changes.join(both, [*scope, "hash"], "left").withColumn("pairs", movable & F.col("pairs").isNotNull())
    alone = marked.where(~F.col("pairs")).select(
        *scope,
        F.col("kind").alias("change_type"),
        F.when(F.col("kind") != "A", F.col("path")).alias("a_path"),
        F.when(F.col("kind") != "D", F.col("path")).alias("b_path"),
        "hash",
    )
    numbered = number_rows(marked.where("pairs"), [*scope, "hash", "kind"], "path", out="pair_no")
    side = {k: F.max(F.when(F.col("kind") == k, F.col("path"))) for k in "AD"}
    paired = numbered.groupBy(*scope, "hash", "pair_no").agg(side["D"].alias("a_path"), side["A"].alias("b_path"))
    change_type = (
        F.when(F.col("a_path").isNull(), F.lit("A")).when(F.col("b_path").isNull(), F.lit("D")).otherwise(F.lit("R"))
    )
    return paired.select(*scope, change_type.alias("change_type"), "a_path", "b_path", "hash").unionByName(alone)


def snapshot_diff(
    old: DataFrame,
    new: DataFrame,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    scope: Sequence[str] = (),
    cut: bool = True,
) -> DataFrame:
    """The change feed ``(*scope, change_type, a_path, b_path, hash)`` with types A, M, D and R.

    Both frames need ``path, hash, size``, with one row per path. ``scope`` names columns that
    tell sources apart when one job compares many of them: paths and renames only match inside
    a scope. The path changes are written to the shared folder before renames are paired, so that
    the join over all paths runs once; without ``cut`` everything stays one lazy plan.
    """
    changes = path_changes(old, new, include, exclude, scope)
    return pair_renames(write_cut(changes, "path-changes") if cut else changes, scope)


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_type").agg(F.count("*").alias("n"))
