"""Many runs over one index: ids are looked up in one pass over it, and what earlier reads have found out is used again."""

from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import functions as F

from tidemark.operators.changes import likely_rows_of_any, resolve_doc_ids
from tidemark.operators.documents import url_documents
from tidemark.plans.index_table import IndexTable
from tidemark.session import cut, scratch_path, scratch_run, shared_dir

FEED = "owner string, index_name string, change_type string, a_path string, b_path string"


def docs(spark, rows, owner="o"):
    frame = spark.createDataFrame(rows, "name string, url string, text string")
    return url_documents(frame, index_name=F.col("name"), owner=owner, run_ts=F.lit("2024-01-01").cast("timestamp"))


def content(index):
    return sorted((r.index_name, r.owner, r.source_uri, r.text) for r in index.read().collect())


def voids_written(spark):
    return len(list(Path(shared_dir(spark).removeprefix("file:")).glob("voids-*")))


def test_ids_of_changes_are_found_in_one_pass_over_the_index(spark):
    index = cut(docs(spark, [("i", f"p{n}", "t") for n in range(3000)] + [("j", "p1", "t")]), "index")
    ids = {(r.index_name, r.source_uri): r.doc_id for r in index.collect()}
    # "gone" was at p5's path before: its id is taken by a document that has moved on; p7 has moved to q7 already
    index = cut(index.withColumn("source_uri", F.expr("CASE source_uri WHEN 'p5' THEN 'elsewhere' WHEN 'p7' THEN 'q7' ELSE source_uri END")), "index")
    feed = [("M", "p1", "p1"), ("D", "p2", None), ("R", "p3", "q3"), ("A", None, "p4"), ("A", None, "p5"), ("R", "p7", "q7"), ("M", "x", "x"), ("D", "y", None)]
    changes = cut(spark.createDataFrame([("o", "i", *c) for c in feed] + [("other", "i", "M", "p1", "p1"), ("o", None, "M", "p1", "p1")], FEED), "feed")
    resolved = resolve_doc_ids(changes, index, "v2")
    assert not set(index.inputFiles()) & set(resolved.inputFiles())
    got = {(r.owner, r.index_name, r.change_type, r.a_path or r.b_path): (r.action, r.doc_id) for r in resolved.collect()}
    assert len(got) == 9 and got["o", "i", "M", "p1"] == ("update", ids["i", "p1"]) and got["o", "i", "D", "p2"] == ("delete", ids["i", "p2"])
    assert got["o", "i", "R", "p3"] == ("update", ids["i", "p3"]) and got["o", "i", "R", "p7"] == ("update", ids["i", "p7"])
    assert got["o", "i", "A", "p4"] == ("create", ids["i", "p4"]) and got["o", "i", "M", "x"][0] == got["other", "i", "M", "p1"][0] == "create"
    assert got["o", "i", "A", "p5"][0] == "create" and got["o", "i", "A", "p5"][1] not in ids.values()


def test_rows_that_any_of_several_keys_wants(spark):
    rows = spark.range(5000).selectExpr("'a' || id AS a", "'b' || id AS b", "id")
    got = likely_rows_of_any(rows, [(rows.where("id < 30").select("a"), ["a"]), (rows.where("id BETWEEN 20 AND 49").select("b"), ["b"])])
    found = [r.id for r in got.collect()]
    assert got.columns == rows.columns and set(range(50)) <= set(found) and len(found) == len(set(found)) <= 55


def test_masks_of_a_state_are_found_once(spark):
    index = IndexTable(spark, scratch_path(spark, "index"))
    index.index_documents(docs(spark, [("i", f"p{n}", "t") for n in range(200)]))
    index.update_documents(docs(spark, [("i", f"p{n}", "new") for n in range(0, 200, 2)]))
    want, before = content(index), voids_written(spark)
    assert content(index) == want and len(want) == 200 and voids_written(spark) == before
    # what a run wrote goes with it: the next read outside starts anew
    with scratch_run(spark):
        assert content(index) == want
    assert content(index) == want and voids_written(spark) == before + 1


def test_reads_between_commits_are_those_of_a_fresh_table(spark):
    rng, root = random.Random(4), scratch_path(spark, "index")
    index = IndexTable(spark, root, fold_after=8)

    def some(n):
        return docs(spark, [(f"i{rng.randrange(2)}", f"u{rng.randrange(70)}", str(rng.random())) for _ in range(n)], rng.choice("oo"))

    index.index_documents(docs(spark, [("i0", f"u{n}", "t") for n in range(70)]))
    for step in ("both", "put", "remove", "replace", "put", "drop", "put", "put", "both"):
        if step == "put":
            index.update_documents(some(20))
        elif step == "remove":
            index.delete_documents(some(9))
        elif step == "both":
            index.apply(upserts=some(9), deletes=some(9))
        elif step == "drop":
            index.drop("i1")
        else:
            # the ids of another owner for a while: once they are replaced, those before them count again
            index.apply(upserts=some(9).withColumn("owner", F.lit("other")))
            index.apply(upserts=some(1), replaces=spark.createDataFrame([("i0", "other")], "index_name string, owner string"))
        fresh = content(IndexTable(spark, root, fold_after=8))
        assert content(index) == fresh and fresh, step
