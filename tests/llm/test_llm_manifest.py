"""The Merkle manifest against plain Python over a whole table, against its SQL, and on odd rows."""

from __future__ import annotations

import hashlib
import zlib
from itertools import groupby

import duckdb
import pytest

from tidemark.llm import merkle
from tidemark.llm.queries import op13_manifest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, k int, tree string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    return h("".join(field(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def climb(nodes):
    """All levels from the leaves to the single root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        start = i - i % 16
        yield "".join(level[start:i]), "".join(level[i + 1 : start + 16])
        i //= 16


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    order = lambda r: (r["source"] is not None, (r["source"] or "").encode(), r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))
    groups = [list(g) for _, g in groupby(sorted(rows, key=order), key=lambda r: r["source"])]
    trees = [climb([leaf(r, r["text"]) for r in g]) for g in groups]
    top = climb([t[-1][0] for t in trees])
    out = []
    for g, (rows_, tree) in enumerate(zip(groups, trees, strict=True)):
        for i, r in enumerate(rows_):
            way = [*siblings(tree, i), *siblings(top, g)]
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            seen = leaf(r, lower(r["text"])) if tampered else leaf(r, r["text"])
            for a, b in way:
                seen = h(a + seen + b)
            out.append((r["doc_id"], tree[0][i], tree[-1][0], top[-1][0], h("".join(a + b for a, b in way)), seen, seen == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_whole_table_equals_plain_python_and_sql(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = got(op13_manifest(spark, SF))
    assert found == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    result = con.execute(merkle.manifest_sql())
    at = [[d[0] for d in result.description].index(c) for c in COLUMNS]
    assert sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=str) == found
    assert {v for *_, v in found} == {True, False}


def test_many_superblocks_and_sources(spark):
    # superblocks of 16 leaves: several tiers in a source, and in the tree of sources
    rows = [(i, f"Text {i}", "en", "hot" if i % 2 else f"s{i % 600:03d}", i, "x", 1, "y") for i in range(1400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(merkle.check(docs, height=1)) == brute([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_sizes(spark, n):
    docs = spark.createDataFrame([(i, "A" * (i % 3), None, "one", i, "x", 1, "y") for i in range(n)], SCHEMA)
    assert got(merkle.check(docs)) == brute([r.asDict() for r in docs.collect()])


def test_odd_rows(spark):
    big = (1 << 53) + 1
    rows = [(None, "No Id", None, None, None), (None, None, "en", "b", 0), (big, "Ünï Ä A", "de", "ä", 7), (big, "Ünï Ä A", "de", "ä", 7), (3, "", "en", "", 0)]
    rows += [(3, "A", "en", "", 1), (5, "X" * 100_000, "en", "Z", 9), (6, "𝒳", "en", "�", 1), (7, "y", "en", "𝒳", 1), (8, "dash", "en", "-", 4)]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in [(a, t, b, s, n) for a, t, b, s, n in rows]], SCHEMA)
    assert got(merkle.check(docs)) == brute([r.asDict() for r in docs.collect()])
    assert merkle.check(docs.limit(0)).collect() == []


def test_equal_rows_are_leaves_each(spark):
    docs = spark.createDataFrame([(1, "Same", "en", "s", 4, "x", 1, "y")] * 300, SCHEMA).repartition(4)
    found = got(merkle.check(docs))
    assert len(found) == 300 and found == brute([r.asDict() for r in docs.collect()])
