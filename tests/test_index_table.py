from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators.documents import url_documents
from tidemark.plans.index_table import IndexTable
from tidemark.session import scratch_path


def docs(spark, texts, index="i"):
    df = spark.createDataFrame(list(texts.items()), "url string, text string")
    return url_documents(df, index_name=index, owner="o", run_ts=F.lit("2024-01-01").cast("timestamp"))


def ids(df, *uris):
    return df.where(F.col("source_uri").isin(*uris)).select("index_name", "doc_id")


@pytest.fixture
def index(spark):
    return IndexTable(spark, scratch_path(spark, "index"))


def texts(index, name=None):
    df = index.read()
    return {r.source_uri: r.text for r in (df if name is None else df.where(F.col("index_name") == name)).collect()}


def names(index):
    return sorted(r.index_name for r in index.list_indexes().collect())


def test_an_empty_index(index):
    assert index.read().count() == 0 and names(index) == []


def test_a_commit_without_rows(spark, index):
    index.index_documents(docs(spark, {"a": ""}))
    assert index.read().count() == 0
    index.index_documents(docs(spark, {"a": "1"}))
    index.delete_documents(ids(index.read(), "nothing"))
    assert texts(index) == {"a": "1"}
    index.compact()
    index.drop("i")
    assert index.read().count() == 0
    index.compact()
    assert index.read().count() == 0


def test_puts_updates_and_removals(spark, index):
    index.index_documents(docs(spark, {"a": "1", "b": "2", "c": "3"}))
    index.update_documents(docs(spark, {"b": "two"}))
    index.delete_documents(ids(index.read(), "c"))
    assert texts(index) == {"a": "1", "b": "two"}
    assert index.obsolete_commits().count() == 0
    index.compact()
    assert index.obsolete_commits().count() == 3
    assert texts(index) == {"a": "1", "b": "two"}
    index.apply(upserts=docs(spark, {"c": "again", "d": "4"}), deletes=ids(index.read(), "a"))
    assert texts(index) == {"b": "two", "c": "again", "d": "4"}
    metadata = index.read().where("source_uri = 'd'").first().metadata
    assert metadata == {"owner": "o", "source_type": "url", "source_url": "d", "timestamp": "2024-01-01T00:00:00.000000Z"}


def test_drop_is_idempotent_and_lets_the_name_be_used_again(spark, index):
    index.drop("never-there")
    index.index_documents(docs(spark, {"a": "1"}))
    index.index_documents(docs(spark, {"x": "9"}, "other"))
    index.drop("i")
    index.drop("i")
    assert texts(index) == {"x": "9"} and names(index) == ["other"]
    index.index_documents(docs(spark, {"b": "2"}))
    assert texts(index, "i") == {"b": "2"}
    index.compact()
    assert texts(index) == {"x": "9", "b": "2"}


def test_a_write_without_commit_does_not_count(spark, index):
    index.index_documents(docs(spark, {"a": "1"}))
    index._write(index._stored(docs(spark, {"a": "lost", "b": "lost"})), index._next())
    assert texts(index) == {"a": "1"}
    index.index_documents(docs(spark, {"c": "3"}))
    assert texts(index) == {"a": "1", "c": "3"}


def test_a_repeated_batch_is_skipped(spark, index):
    assert index.apply(upserts=docs(spark, {"a": "1"}), writer="w", batch_id=0)
    assert not index.apply(upserts=docs(spark, {"a": "late"}), writer="w", batch_id=0)
    assert index.apply(upserts=docs(spark, {"b": "2"}), writer="w", batch_id=1)
    assert index.apply(upserts=docs(spark, {"c": "3"}), writer="other", batch_id=0)
    assert texts(index) == {"a": "1", "b": "2", "c": "3"}
    assert index.apply() is False


def test_one_row_per_id_in_a_commit(spark, index):
    twice = docs(spark, {"a": "1"}).unionByName(docs(spark, {"a": "2"}))
    ordered = twice.withColumn("_seq", F.when(F.col("text") == "1", 2).otherwise(1).cast("long"))
    index.apply(upserts=ordered)
    assert texts(index) == {"a": "1"} and index.commits().first().kind == "change"
    index.apply(upserts=twice)
    assert index.read().count() == 1
    one = docs(spark, {"b": "x"})
    index.apply(upserts=one, deletes=one.select("index_name", "doc_id"))
    assert texts(index)["b"] == "x"
    gone = one.select("index_name", "doc_id", F.lit(2).cast("long").alias("_seq"))
    index.apply(upserts=one.withColumn("_seq", F.lit(1).cast("long")), deletes=gone)
    assert "b" not in texts(index)
    index.compact()
    assert index.read().count() == 1


def test_the_first_commit_is_a_full_copy_and_changes_are_folded(spark):
    index = IndexTable(spark, scratch_path(spark, "index"), fold_after=2)
    index.index_documents(docs(spark, {"a": "1"}))
    assert [r.kind for r in index.commits().collect()] == ["full"]
    for i in range(3):
        index.index_documents(docs(spark, {f"u{i}": "t"}))
    assert sorted(r.kind for r in index.commits().collect()) == ["change", "change", "change", "full", "full"]
    assert set(texts(index)) == {"a", "u0", "u1", "u2"}


def test_persist_and_load(spark, index):
    index.index_documents(docs(spark, {"a": "1", "b": "2"}))
    path = scratch_path(spark, "copy")
    index.persist("i", path)
    index.update_documents(docs(spark, {"a": "changed", "c": "3"}))
    index.load("i", path, overwrite=False)
    assert texts(index) == {"a": "changed", "b": "2", "c": "3"}
    index.load("i", path)
    assert texts(index) == {"a": "1", "b": "2"}


def test_pages(spark, index):
    index.index_documents(docs(spark, {f"u{i}": "t" for i in range(12)}))
    all_ids = sorted(r.doc_id for r in index.read().collect())
    assert [r.doc_id for r in index.list_documents("i").collect()] == all_ids[:10]
    assert [r.doc_id for r in index.list_documents("i", {"owner": "o"}, 5, 10).collect()] == all_ids[10:]
    assert index.list_documents("i", {"owner": "nobody"}).count() == 0


def test_reading_changes_does_not_shuffle_the_full_copy(spark, index):
    """Only the few changed ids move: they are broadcast to the scan of the full copy."""
    index.index_documents(docs(spark, {f"u{i}": "t" for i in range(50)}))
    index.compact()
    index.update_documents(docs(spark, {"u1": "new"}))
    df = index.read()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in final and "LeftAnti" in final
    assert final.count("BroadcastExchange") >= 1


def test_index_name_prunes_partitions(spark, index):
    index.index_documents(docs(spark, {"a": "1"}))
    index.index_documents(docs(spark, {"b": "2"}, "other"))
    index.compact()
    plan = index.read().where(F.col("index_name") == "i")._jdf.queryExecution().executedPlan().toString()
    assert "(index_name" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_drop_many_in_one_commit(spark, index):
    for name in ("a", "b", "c"):
        index.index_documents(docs(spark, {name: "t"}, name))
    index.drop_all(spark.createDataFrame([("a",), ("c",), ("a",), ("unknown",)], "index_name string"))
    assert names(index) == ["b"]
    index.index_documents(docs(spark, {"a": "t"}, "a"))
    assert names(index) == ["a", "b"]


def test_replace_takes_only_the_owners_documents(spark, index):
    index.index_documents(docs(spark, {"a": "1", "b": "2"}))
    index.compact()
    index.index_documents(docs(spark, {"c": "3"}))
    def named(*pairs):
        return spark.createDataFrame(list(pairs), "index_name string, owner string")

    index.apply(upserts=docs(spark, {"b": "two", "d": "4"}), replaces=named(("i", "o"), ("k", "o")))
    assert texts(index) == {"b": "two", "d": "4"}
    index.apply(upserts=docs(spark, {"z": "9"}), replaces=named(("i", "someone else")))
    assert texts(index) == {"b": "two", "d": "4", "z": "9"}


def test_a_copy_under_another_name_leaves_the_original_alone(spark, index):
    index.index_documents(docs(spark, {"a": "1"}))
    path = scratch_path(spark, "copy")
    index.persist("i", path)
    index.compact()
    index.load("j", path)
    assert texts(index, "i") == texts(index, "j") == {"a": "1"}
    index.delete_documents(index.read().where("index_name = 'j'"))
    assert texts(index, "i") == {"a": "1"} and texts(index, "j") == {}


def test_a_filter_on_the_index_reaches_every_scan(spark, index):
    index.index_documents(docs(spark, {"a": "1"}))
    index.compact()
    index.index_documents(docs(spark, {"b": "2"}, "j"))
    plan = index.read().where("index_name = 'j'")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(scans) >= 3 and all("index_name" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)


def test_names_follow_changes_and_drops(spark, index):
    every = docs(spark, {"a": "1", "b": "2"}, "one").unionByName(docs(spark, {"a": "1"}, "two")).unionByName(docs(spark, {"a": "1"}, "three"))
    index.index_documents(every)
    assert names(index) == ["one", "three", "two"]
    index.delete_documents(ids(index.read().where("index_name = 'two'"), "a"))
    index.index_documents(docs(spark, {"x": "1"}, "four"))
    index.update_documents(docs(spark, {"b": "new"}, "one"))
    assert names(index) == ["four", "one", "three"]
    # of an index that no change touches only the name is read
    plan = index.list_indexes()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text#") <= plan.count("Relation [") * 2
    index.drop("three")
    index.delete_documents(ids(index.read().where("index_name = 'four'"), "x"))
    assert names(index) == ["one"]
    index.compact()
    assert names(index) == ["one"]


def test_landed_counts_are_those_of_a_scan(spark):
    """Random commits: after each one the landed counts equal a count of all documents, and they read no document."""
    import random

    rng, index = random.Random(8), IndexTable(spark, scratch_path(spark, "index"), fold_after=4, keep_counts=True)
    assert index.counts().collect() == []

    def some(n):
        rows = {(f"i{rng.randrange(2)}", f"u{rng.randrange(12)}"): rng.choice("abc") for _ in range(n)}
        frames = spark.createDataFrame([(i, u, o, "t") for (i, u), o in rows.items()], "i string, url string, o string, text string")
        at = F.lit("2024-01-01").cast("timestamp")
        docs_ = url_documents(frames, index_name=F.col("i"), owner=F.lit("o"), run_ts=at)
        return docs_.join(frames.select(F.col("i").alias("index_name"), F.col("url").alias("source_uri"), F.col("o").alias("_o")), ["index_name", "source_uri"]).withColumn("owner", F.col("_o")).drop("_o")

    for step in range(8):
        kind = ["put", "both", "replace", "drop", "put", "remove", "put", "both"][step]
        if kind == "put":
            index.index_documents(some(8))
        elif kind == "remove":
            index.delete_documents(some(6))
        elif kind == "both":
            index.apply(upserts=some(5), deletes=some(5))
        elif kind == "replace":
            index.apply(upserts=some(4).withColumn("owner", F.lit("a")), replaces=spark.createDataFrame([("i0", "a"), ("i1", "a")], "index_name string, owner string"))
        else:
            index.drop("i1")
        assert index.miscounts().collect() == [], kind
    assert sum(r.n_documents for r in index.counts().collect()) == index.read().count() > 0
    index.compact()
    assert index.miscounts().collect() == []
    plan = index.counts()._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_id" not in plan and "text" not in plan
    with pytest.raises(ValueError):
        IndexTable(spark, index.root).counts()
