"""Merkle manifest of a dataset: a digest per row, per source and for all, with a proof for each row.

A leaf is the digest of a row's fields. In each source the leaves ascend by id; runs of ``RUN`` nodes become their digest until one
is left, the subroot; the subroots, by source, become the root in the same way. The siblings along the way are a row's
proof: with them alone its leaf folds up to the root, and a changed row does not.

A superblock is a subtree of ``RUN ** height`` nodes. On the way up each superblock becomes one node, in expressions, until each
tree is one node. On the way down the nodes of a superblock and what lies outside of it (the siblings of the superblock itself
along its way to the root) are cogrouped by superblock; one function rebuilds the levels inside, joins the inner and the outer
part of each proof, and folds. So every subtree is worked on where its leaves are, and what crosses between tasks are a few siblings.

Bounds: a task holds the leaves of one superblock (4,096 rows of three digests) and at most 15 digests a level from outside. A source of
any size is as many superblocks as it needs; places are found by ranges over (source, id) and the counts before each range, so
no source is ever in one task. The driver gets the root.

Defined results: rows without a source form a source of their own, the first; a null id comes before all others; rows that agree in
source and id ascend by leaf; repeated rows are leaves each; a null id is never tampered; an empty text is no null; no rows, no
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

RUN = 16
#: Levels inside a superblock: 4,096 leaves.
HEIGHT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "tree string, k bigint"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(value: Column) -> Column:
    """One field of a leaf: - for null, else its length in UTF-8 bytes, a colon, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """tree (an ordered form of the source), id, leaf, and seen: the leaf of the row if it was tampered with."""
    docs = docs.select(*FIELDS)
    original = [field(F.col(c)) for c in FIELDS]
    changed = [*original[:-1], field(F.translate("text", _UPPER, _UPPER.lower()))]
    return docs.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("tree"),
        F.col("doc_id").alias("id"),
        digest(*original).alias("leaf"),
        F.when(tampered, digest(*changed)).alias("seen"),
    )


def number(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add k, the place of each row in its tree, and n, the rows of the tree.

    Rows are dealt into ranges of (tree, order); a place is the place in the range plus the counts of the ranges before. Rows
    that are equal in all of it are told apart by where they were read, so that they do not crowd one range.
    """
    rows = cut(rows.withColumn("_tie", F.monotonically_increasing_id()), f"{name}-rows")
    by = [F.col(c).asc_nulls_first() for c in ["tree", *order, "_tie"]]
    ranged = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).drop("_tie"), f"{name}-ranges")
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33))
    runs = ranged.groupBy("tree", "_range").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    # one row per range and tree: a tree has no more of them than there are ranges
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_rows").over(tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = cut(runs.select("tree", "_range", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(tree).alias("n")), f"{name}-runs")
    return ranged.join(runs, ["tree", "_range"]).withColumn("k", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")


def _up(nodes: Column) -> Column:
    """The next level: digests of runs of nodes."""
    starts = F.sequence(F.lit(1), F.size(nodes), F.lit(RUN))
    return F.transform(starts, lambda s: F.sha2(F.array_join(F.slice(nodes, s, RUN), ""), 256))


def _block(height: int) -> Column:
    """The superblock that a node is in: its place without its last digits in base RUN."""
    return F.floor(F.col("k") / RUN**height)


def _reduce(nodes: DataFrame, height: int) -> DataFrame:
    """Each superblock of (tree, k, n, h) as one node of the tier above; a tree of one node stays that node."""
    found = nodes.groupBy("tree", _block(height).alias("k"), "n").agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("_run"))
    found = found.withColumn("_run", F.transform("_run", lambda x: x["h"]))
    for level in range(height):
        # a level is built while more than one node of the whole tree is left
        found = found.withColumn("_run", F.when(F.col("n") > RUN**level, _up(F.col("_run"))).otherwise(F.col("_run")))
    return found.select("tree", "k", F.ceil(F.col("n") / RUN**height).alias("n"), F.get("_run", F.lit(0)).alias("h"))


def tiers(nodes: DataFrame, name: str, height: int = HEIGHT) -> list[DataFrame]:
    """The nodes, their superblocks as nodes, and so on until each tree is one node: one tier for every 4,096-fold."""
    out = [nodes]
    while len(out) == 1 or not out[-1].where("n > 1").isEmpty():
        out.append(cut(_reduce(out[-1].select("tree", "k", "n", "h"), height), f"{name}-{len(out)}"))
    return out


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(h: list[str], n: int, height: int) -> list[list[str]]:
    """The levels of a superblock from its nodes up to the one before its root."""
    levels = []
    for level in range(height):
        if n <= RUN**level:
            break
        levels.append(h)
        h = [_sha("".join(h[i : i + RUN])) for i in range(0, len(h), RUN)]
    return levels


def _sides(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """The siblings of node i before and after it, level by level."""
    out = []
    for level in levels:
        start = i - i % RUN
        out.append(("".join(level[start:i]), "".join(level[i + 1 : start + RUN])))
        i //= RUN
    return out


def _descend(height: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The siblings of each node of a superblock up to the root."""

    def descend(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("k")
        levels = _levels(nodes["h"].tolist(), int(nodes["n"].iloc[0]), height)
        sides = [_sides(levels, i) for i in range(len(nodes))]
        before, after = list(outer["before"].iloc[0]), list(outer["after"].iloc[0])
        return pd.DataFrame(
            {
                "tree": nodes["tree"],
                "k": nodes["k"],
                "before": [[a for a, _ in s] + before for s in sides],
                "after": [[b for _, b in s] + after for s in sides],
            }
        )

    return descend


def _prove(root: str, height: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Per leaf of a superblock: its proof's digest, and the root that its leaf as seen folds up to."""

    def prove(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("k")
        levels = _levels(nodes["h"].tolist(), int(nodes["n"].iloc[0]), height)
        far = list(zip(outer["before"].iloc[0], outer["after"].iloc[0], strict=True))
        beyond = "".join(a + b for a, b in far)
        proofs, folded = [], []
        above: dict[str, str] = {}  # what the superblock's root folds up to: nearly all leaves agree on it
        for i, h in enumerate(nodes["seen"]):
            sides = _sides(levels, i)
            proofs.append(_sha("".join(a + b for a, b in sides) + beyond))
            for a, b in sides:
                h = _sha(a + h + b)
            if h not in above:
                top = h
                for a, b in far:
                    top = _sha(a + top + b)
                above[h] = top
            folded.append(above[h])
        return pd.DataFrame(
            {
                "doc_id": nodes["id"],
                "leaf": nodes["h"],
                "subroot": outer["subroot"].iloc[0],
                "root": root,
                "proof_sha256": proofs,
                "folded_root": folded,
                "verified": [f == root for f in folded],
            }
        )

    return prove


def _outer(paths: DataFrame) -> DataFrame:
    return paths.withColumnRenamed("k", "block")


def _paths(tier: DataFrame, outer: DataFrame, name: str, height: int) -> DataFrame:
    """tree, k, and the siblings before and after per level, for each node of a tier, from those of the tier above."""
    nodes = tier.select("tree", "k", "n", "h", _block(height).alias("block")).groupBy("tree", "block")
    found = nodes.cogroup(_outer(outer).groupBy("tree", "block")).applyInPandas(_descend(height), f"{_NODES}, before array<string>, after array<string>")
    return cut(found, name)


def manifest(docs: DataFrame, tampered: Column, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root and proof_sha256 of each row as it is; folded_root and verified of the row as tampered with."""
    rows = number(leaves(docs, tampered), ["id", "leaf"], "merkle-leaves").withColumnRenamed("leaf", "h")
    inner = tiers(rows, "merkle-tier", height)
    subroots = inner[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "h")
    sources = cut(number(subroots, ["name"], "merkle-sources"), "merkle-sources")
    upper = tiers(sources, "merkle-upper", height)
    top = upper[-1].select("h").collect()  # one row, or none
    root = top[0]["h"] if top else ""
    none = F.array().cast("array<string>")
    paths = upper[-1].select("tree", "k", none.alias("before"), none.alias("after"))
    for i in range(len(upper) - 2, -1, -1):
        paths = _paths(upper[i], paths, f"merkle-upper-paths-{i}", height)
    # the way of a source is the way of the one node of its last tier
    paths = paths.join(sources.select("tree", "k", "name"), ["tree", "k"]).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("k"), "before", "after")
    for i in range(len(inner) - 2, 0, -1):
        paths = _paths(inner[i], paths, f"merkle-paths-{i}", height)
    known = _outer(paths).join(inner[-1].select("tree", F.col("h").alias("subroot")), "tree")
    # ids travel as text: pandas has no integers with nulls
    seen, id_text = F.coalesce("seen", "h").alias("seen"), F.col("id").cast("string").alias("id")
    nodes = rows.select("tree", "k", "n", "h", seen, id_text, _block(height).alias("block")).groupBy("tree", "block")
    proven = nodes.cogroup(known.groupBy("tree", "block")).applyInPandas(
        _prove(root, height), "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
    return proven.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def check(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The manifest, where the rows whose id has a CRC-32 that 5 divides were put into lower case behind its back."""
    return manifest(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, height)


def manifest_sql(levels: int = 6) -> str:
    """The same as DuckDB SQL, with as many levels written out: trees of at most 16 ** levels nodes."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in FIELDS[:-1])} || {field(text)})"
    crc = (
        "xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(c)::BIGINT for c in string_split(CAST(doc_id AS VARCHAR), '')]), "
        "lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda v, _: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
    )
    out = [
        f"""seen AS (
  SELECT doc_id, coalesce('=' || source, '-') AS tree, {leaf("text")} AS leaf,
    CASE WHEN {crc} % 5 = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} END AS other
  FROM documents),
a0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY tree) AS n FROM seen),
n0 AS (SELECT tree, k, n, leaf AS h FROM a0)"""
    ]

    def climb(prefix: str) -> None:
        for i in range(levels):
            out.append(
                f"""{prefix}{i + 1} AS (SELECT tree, k // {RUN} AS k, (any_value(n) + {RUN - 1}) // {RUN} AS n,
  CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY k)) END AS h FROM {prefix}{i} GROUP BY tree, k // {RUN})"""
            )

    climb("n")
    out.append(f"m0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS k, count(*) OVER () AS n, h, tree AS name FROM n{levels})")
    climb("m")
    # the siblings of every row: up its source, then up the sources
    ways, steps = ["a0 JOIN m0 ON m0.name = a0.tree"], []
    for i in range(2 * levels):
        table, tree, at = (f"n{i}", "a0.tree", f"a0.k // {RUN**i}") if i < levels else (f"m{i - levels}", "''", f"m0.k // {RUN ** (i - levels)}")
        beside = f"string_agg(h, '') OVER (PARTITION BY tree, k // {RUN} ORDER BY k ROWS BETWEEN"
        out.append(
            f"""s{i} AS (SELECT tree, k, coalesce({beside} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce({beside} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {table} WHERE n > 1)"""
        )
        ways.append(f"LEFT JOIN s{i} ON s{i}.tree = {tree} AND s{i}.k = {at}")
        steps.append(f"coalesce(s{i}.l, '') AS l{i}, coalesce(s{i}.r, '') AS r{i}")
    out.append(
        f"""ways AS (SELECT a0.doc_id, a0.leaf, coalesce(a0.other, a0.leaf) AS f0, m0.h AS subroot, a0.n, m0.n AS m, {", ".join(steps)}
  FROM {" ".join(ways)})"""
    )
    fold = f"f{2 * levels}"
    for i in range(2 * levels):
        many = f"n > {RUN**i}" if i < levels else f"m > {RUN ** (i - levels)}"
        out.append(f"g{i + 1} AS (SELECT *, CASE WHEN {many} THEN sha256(l{i} || f{i} || r{i}) ELSE f{i} END AS f{i + 1} FROM {'ways' if not i else f'g{i}'})")
    proof = " || ".join(f"l{i} || r{i}" for i in range(2 * levels))
    return f"""WITH {", ".join(out)}
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, {fold} AS folded_root, {fold} = root AS verified
FROM g{2 * levels}, (SELECT h AS root FROM m{levels})"""
