"""Document fingerprints: of all hashes of five-word shingles, those below a fixed fraction of the hash range.

The same threshold holds for every text, so sketches of very unequal texts compare, and the sketch of a union is the
union of sketches. Words are runs of anything but ASCII white space. A text shorter than five words is one shingle; a text
with no hash below the threshold keeps its least one, so that only texts without words have an empty sketch.
DataFrame expressions only.

Defined results: null text counts as empty; texts that are equal have equal fingerprints; two empty sketches are alike
(1.0), an empty and another are not (0.0). The order of documents is that of distinct (doc_id, text),
null ids first, equal ids by the hash of their text; rows that repeat get equal results. Other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

WORDS = 5
#: One hash of ``2 ** SCALE_BITS`` is kept.
SCALE_BITS = 2


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"[\t\n\x0B\f\r ]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def window_hashes(hashes: Column, size: int) -> Column:
    """Non-negative hashes of all runs of ``size``; of the whole, where it is shorter but not empty."""
    runs = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - size),
        lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]), 1),
    )
    short = F.array(F.shiftrightunsigned(F.xxhash64(hashes), 1))
    return F.when(F.size(hashes) >= size, runs).when(F.size(hashes) > 0, short).otherwise(F.array().cast("array<bigint>"))


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the sorted array of kept hashes of a text column."""
    h, all_, low = (f"_{out}_{x}" for x in ("words", "all", "low"))
    threshold = 1 << (63 - SCALE_BITS)
    return (
        df.withColumn(h, word_hashes(F.col(text)))
        .withColumn(all_, window_hashes(F.col(h), WORDS))
        .withColumn(low, F.filter(all_, lambda x: x < threshold))
        .withColumn(
            out,
            F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low)))
            .when(F.size(all_) > 0, F.array(F.array_min(all_)))
            .otherwise(F.array().cast("array<bigint>")),
        )
        .drop(h, all_, low)
    )


def as_text(sketch: str | Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: str | Column, b: str | Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a if isinstance(a, Column) else F.col(a)) + F.size(b if isinstance(b, Column) else F.col(b)) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def containment(a: str, b: str) -> Column:
    """Estimated part of the first text's shingles that the second one has."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: str, b: str) -> Column:
    """The sketch of two texts together (but for texts that only kept their least hash)."""
    return F.array_sort(F.array_union(a, b))


def _order(docs: DataFrame) -> DataFrame:
    """For each distinct (doc_id, digest) the one before it, and how much of this text goes into that one's edited text.

    Ids are dealt out by range; each range is numbered on its own, and its first row closes the range before it. After
    the last document comes the first.
    """
    ids = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.length("text").alias("n")).distinct()
    ranged = cut(ids.repartitionByRange(256, "doc_id", "digest").withColumn("part", F.spark_partition_id()), "ranges")
    key = F.struct("doc_id", "digest", "n")
    edges = ranged.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    # at most 256 rows: one per range
    turn = Window.orderBy("part")
    before = edges.select(
        F.col("part").alias("edge_part"),
        F.coalesce(F.lag("last").over(turn), F.last("last").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("edge"),
    )
    inside = Window.partitionBy("part").orderBy("doc_id", "digest")
    return (
        ranged.withColumn("previous", F.lag(key).over(inside))
        .join(F.broadcast(before), F.col("part") == F.col("edge_part"))
        .withColumn("previous", F.coalesce("previous", "edge"))
        .select(
            F.col("doc_id").alias("own_id"),
            F.col("digest").alias("own_digest"),
            F.col("previous.doc_id").alias("to_id"),
            F.col("previous.digest").alias("to_digest"),
            F.floor(F.col("previous.n") / 2).cast("int").alias("half"),
        )
    )


def _id_key(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and their edited texts, and the likeness to those and to the next document."""
    id_type = docs.schema["doc_id"].dataType
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # both joins below read this by the same keys: texts are shuffled once
    keyed = texts.select(_id_key("doc_id").alias("id_key"), F.xxhash64("text").alias("digest"), "text")
    links = _order(texts).select(
        _id_key("own_id").alias("id_key"), F.col("own_digest").alias("digest"), _id_key("to_id").alias("to_key"), "to_digest", "half"
    )
    # each document sends its beginning and its sketch to the one before it
    beginnings = keyed.join(links, ["id_key", "digest"]).select("to_key", "to_digest", F.left("text", "half").alias("head"), "text")
    sent = (
        with_sketch(beginnings, "text", "next_sketch")
        .select(F.col("to_key").alias("id_key"), F.col("to_digest").alias("digest"), "head", "next_sketch")
        .dropDuplicates(["id_key", "digest"])
    )
    half = F.floor(F.length("text") / 2).cast("int")
    joined = keyed.join(sent, ["id_key", "digest"]).withColumn("edited", F.concat(F.left("text", F.length("text") - half), "head"))
    both = with_sketch(with_sketch(joined, "text", "sketch"), "edited", "edited_sketch")
    return both.select(
        F.when(F.col("id_key") != "\u0000", F.col("id_key")).cast(id_type).alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("sketch").alias("fingerprint"),
        as_text("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )
