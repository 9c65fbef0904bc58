"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them: those above the node, or those below it and itself.

    The least neighbour is an aggregate that is joined back, so no node's neighbours are ever gathered in one place.
    """
    if large:
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        seen = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = seen.join(least, "u")
    out = joined.where(F.col("v") > F.col("u")) if large else joined
    linked = out.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        linked = linked.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of an edge: root is the least node of its component.

    Takes columns a and b. Rounds grow with the logarithm of the number of nodes; each is written, so that no lineage
    builds up and a lost executor costs one round.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, before = cut(edges, name), None
    while True:
        # edges point down to the least node once nothing changes
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (state["n"], state["s"]) == before or not state["n"]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = (state["n"], state["s"])
        current = cut(_stars(_stars(current, large=True), large=False), name)


def meetings(blocks: DataFrame) -> DataFrame:
    """Rows of a block, once for every block of their key that it meets, itself included: low and high name the two.

    Takes ``block`` (from 0) and ``parts``, the number of blocks of the row's key.
    """
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("_other")
    each = blocks.select("*", other)
    return each.withColumn("low", F.least("block", "_other")).withColumn("high", F.greatest("block", "_other")).drop("_other", "parts")
