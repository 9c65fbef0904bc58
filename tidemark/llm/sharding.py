"""Sharding by extendible hashing: a directory indexed by the leading bits of a hash, whose buckets split on one
more bit only while they are over the byte limit.

Every row has 60 bits, from an MD5 of its id and text. Sizes are summed per leading ``ROUND_BITS`` bits and
rolled up to all shorter prefixes; a row's shard is its shortest prefix that fits. What is too large even at
that depth goes through the next round, on the next bits. Only ids, hashes and sizes are shuffled.

Defined results: a row larger than the limit is a shard of its own, named ``big-``, its bits and its number among the rows equal to it; rows that are
equal in id and text share all bits, so a group of them that is too large is cut by a running number into pieces named
after the prefix; null ids and null texts count as empty; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from ..session import cut

BITS = 60
#: Bits that one round looks at: a directory has at most ``2 ** ROUND_BITS`` rows per bucket that is still too large.
ROUND_BITS = 12


def _hashed(docs: DataFrame, keep: list[str]) -> DataFrame:
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    digits = F.substring(F.md5(key), 1, BITS // 4)
    bits = F.lpad(F.conv(digits, 16, 2), BITS, "0")
    return docs.select("doc_id", *keep, bits.alias("bits"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))


def _directory(rows: DataFrame, done: int, limit: int) -> DataFrame:
    """(cell, shard): for each cell of ``done + ROUND_BITS`` bits the shortest prefix that fits, or null."""
    deep = min(BITS, done + ROUND_BITS)
    cells = rows.groupBy(F.substring("bits", 1, deep).alias("cell")).agg(F.sum("bytes").alias("bytes"))
    prefixes = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(done), F.lit(deep))).alias("depth")).select(
        "cell", "bytes", F.substr("cell", F.lit(1), F.col("depth")).alias("prefix")
    )
    fits = prefixes.groupBy("prefix").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") <= limit).select("prefix")
    shortest = prefixes.join(fits, "prefix").groupBy("cell").agg(F.min("prefix").alias("shard"))
    return cells.select("cell").join(shortest, "cell", "left")


def assign(docs: DataFrame, limit: int, keep: list[str] | None = None) -> DataFrame:
    """doc_id, shard, depth (bits used), bytes of the row, and shard_bytes, of every row; and the columns to keep."""
    keep = keep or []
    rows = cut(_hashed(docs, keep), "shard-rows")
    big = _cut_equal(rows.where(F.col("bytes") > limit), limit, keep)
    parts = [big.withColumn("shard", F.concat(F.lit("big-"), "shard"))]
    left, done = rows.where(F.col("bytes") <= limit), 0
    while True:
        deep = min(BITS, done + ROUND_BITS)
        directory = cut(_directory(left, done, limit), "shard-directory")
        placed = left.withColumn("cell", F.substring("bits", 1, deep)).join(directory, "cell")
        fit = F.col("shard").isNotNull()
        parts.append(placed.where(fit).select("doc_id", *keep, "bytes", "shard", F.length("shard").alias("depth")))
        if directory.where(~fit).isEmpty():
            break
        left, done = placed.where(~fit).select("doc_id", *keep, "bits", "bytes"), deep
        if done == BITS:
            parts.append(_cut_equal(left, limit, keep))
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.withColumn("depth", F.col("depth").cast("int"))
    sizes = out.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"))
    return out.join(sizes, "shard").select("doc_id", *keep, "shard", "depth", "bytes", "shard_bytes")


def _cut_equal(rows: DataFrame, limit: int, keep: list[str]) -> DataFrame:
    """Rows that agree in all bits are equal, also in size: so many to a piece as fit."""
    numbered = number_rows(
        cut(rows.withColumn("_row", F.monotonically_increasing_id()), "shard-equal"), ["bits"], "_row", out="_position"
    )
    piece = F.floor((F.col("_position") - 1) / F.greatest(F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1))), F.lit(1)))
    return numbered.select("doc_id", *keep, "bytes", F.concat_ws("-", "bits", piece.cast("string")).alias("shard"), F.lit(BITS).alias("depth"))


def write_shards(docs: DataFrame, path: str, limit: int) -> None:
    """Write ids and texts, one folder per shard; the rows of a shard meet in one task, which its limit bounds."""
    assign(docs, limit, ["text"]).select("doc_id", "text", "shard").repartition("shard").write.partitionBy("shard").parquet(path)
