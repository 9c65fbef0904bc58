"""The key store: exact answers, flat reads, repeated batches, and what a job that died leaves."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import scratch_path
from tidemark.streaming.feeds import land_new, read_stream
from tidemark.streaming.keys import KeyStore


def frame(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def read_bytes(folders):
    return sum(os.path.getsize(os.path.join(f, n)) for f in folders for n in os.listdir(f) if n.endswith(".parquet"))


def test_what_a_batch_reads_does_not_grow(spark):
    """Random keys, a fifth of them seen before: answers are exact, and the rows and bytes read stay level while the store grows twelvefold."""
    rng, seen = random.Random(3), set()
    store = KeyStore(spark, scratch_path(spark, "keys"), T.StringType(), keys_per_bucket=40, fan=4)
    rows, read = [], []
    for b in range(24):
        fresh = {f"k{rng.randrange(10**9)}" for _ in range(400)}
        asked = {f"k{rng.randrange(10**9)}" for _ in range(8)} | set(rng.sample(sorted(seen), 2) if seen else [])
        keys = frame(spark, asked)
        assert {r.key for r in store.known(keys, "s", b).collect()} == asked & seen
        rows.append(store.candidates(keys).count())
        read.append(read_bytes([f.removeprefix("file:") for f in store._folders(keys)]))
        store.add(frame(spark, fresh), "s", b)
        seen |= fresh
    assert len(store.segments()) <= 3 * 3 and sum(s["n"] for s in store.segments()) == len(seen) > 9000
    # ten keys open ten buckets per segment at most
    assert max(rows[12:]) <= 10 * 40 * 2 * 6 and max(rows[12:]) < len(seen) / 3
    early, late = sum(rows[6:12]) / 6, sum(rows[18:]) / 6
    assert late < 2 * early
    assert sum(read[18:]) < 2 * sum(read[6:12])


def test_a_repeated_batch_and_many_keys(spark):
    store = KeyStore(spark, scratch_path(spark, "keys"), T.StringType(), keys_per_bucket=5, fan=3)
    for b in range(4):
        store.add(frame(spark, [f"{b}-{i}" for i in range(12)]), "s", b)
    every = frame(spark, [f"{b}-{i}" for b in range(5) for i in range(12)])
    assert store.known(every, "s", 9).count() == 48
    # a batch that is run again does not know its own keys, merged or not
    assert {r.key.split("-")[0] for r in store.known(every, "s", 0).collect()} == {"1", "2", "3"}
    store.add(frame(spark, [f"0-{i}" for i in range(12)]), "s", 0)
    assert store.known(every, "other", 0).count() == 48
    store.add(frame(spark, []), "s", 4)
    assert {(r.stream, r.batch_id) for r in store.batches().collect()} == {("s", b) for b in range(5)}


def test_keys_of_a_dead_job_are_found_in_its_rows(spark):
    root, schema = scratch_path(spark, "dead"), "id long, owner string"
    spark.createDataFrame([(1, "a"), (2, "a")], schema).write.parquet(f"{root}/in")
    # rows that were landed by a job that died before it stored their keys
    spark.createDataFrame([(2, "a"), (7, "z"), (None, "n")], schema).write.parquet(f"{root}/out/stream=gone/batch_id=0")
    stream = read_stream(spark, f"{root}/in", spark.createDataFrame([], schema).schema)
    for checkpoint in ("one", "one", "two"):
        landed = land_new(stream, "id", f"{root}/out", f"{root}/{checkpoint}")
        assert sorted(r.id for r in landed.where(F.col("id").isNotNull()).collect()) == [1, 2, 7]


def test_other_types_of_keys(spark):
    store = KeyStore(spark, scratch_path(spark, "keys"), T.LongType(), keys_per_bucket=2)
    numbers = spark.createDataFrame([(i,) for i in range(20)], "key long")
    assert store.known(numbers, "s", 0).count() == 0
    store.add(numbers.where("key % 2 = 0"), "s", 0)
    assert sorted(r.key for r in store.known(numbers, "s", 1).collect()) == list(range(0, 20, 2))
