"""Centroid clustering: equal to plain rounds to the last unit, fewer distances, odd vectors."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np

from tidemark.llm import centroids
from tidemark.llm.queries import op11_clusters

SF = "/root/testdata/sf0.001"


def plain(rows, k=40, rounds=5):
    """Lloyd rounds in Python's integers."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "")
    cents = [v for _, v in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:k]]
    if not kept:
        return [], []
    v = np.array([x for _, x in kept], object)
    for r in range(rounds + 1):
        c = np.array(cents, object)
        d = np.stack([((v - x) ** 2).sum(1) for x in c], 1)
        best = [min(range(len(cents)), key=lambda j: (row[j], j)) for row in d]
        if r < rounds:
            for j in range(len(cents)):
                own = [x for b, x in zip(best, v, strict=True) if b == j]
                if own:
                    cents[j] = [int(s) // len(own) for s in np.sum(own, axis=0)]
    dist = [int(d[i, b]) for i, b in enumerate(best)]
    inertia = {j: sum(x for x, b in zip(dist, best, strict=True) if b == j) for j in set(best)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    top = (1 << 63) - 1
    out = [(i, b, min(x, top), min(inertia[b], top), min(sum(dist), top), digest[b]) for (i, _), b, x in zip(kept, best, dist, strict=True)]
    return sorted(out, key=str), cents


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_whole_table_equals_plain_rounds_and_sql(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = got(op11_clusters(spark, SF))
    assert found == plain(rows)[0]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    result = con.execute(centroids.cluster_sql())
    at = [[d[0] for d in result.description].index(c) for c in COLUMNS]
    assert sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=str) == found


def test_bounds_spare_most_distances(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 4, (40, 64))
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(0, 0.4, 64)]) for i in range(3000)]
    found = centroids.vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    state, history, work = centroids.rounds(found, centroids.seeds(found))
    assert [int(w["vectors"]) for w in work] == [3000] * 6
    assert int(work[0]["distances"]) == 3000 * 40
    # the later passes work out far fewer than all distances
    assert all(int(w["distances"]) < 3000 * 40 / 4 for w in work[3:])
    _, cents = plain(rows)
    assert history[-1].tolist() == cents


def test_bounds_hold_over_many_rounds():
    """Random walks of centroids: every state is that of a full scan, and no bound is broken."""
    rng = np.random.default_rng(5)
    v = rng.integers(-30, 30, (400, 64))
    history = rng.integers(-30, 30, (1, 23, 64))
    state = centroids.assign_rows(history, v, None)
    for _ in range(12):
        step = rng.integers(-6, 7, history[-1].shape) * (rng.random((23, 1)) < 0.5)
        history = np.concatenate([history, (history[-1] + step)[None]])
        state = centroids.assign_rows(history, v, state)
        full = ((v[:, None, :] - history[-1][None]) ** 2).sum(2)
        assert (state["cluster"] == full.argmin(1)).all()
        assert (state["distance"] == full.min(1)).all()


def test_ties_go_to_the_smaller_number():
    v = np.array([[0, 0], [2, 0], [1, 0]])
    history = np.array([[[0, 0], [2, 0]], [[2, 0], [0, 0]], [[1, 1], [1, -1]]])
    state = centroids.assign_rows(history[:1], v, None)
    assert state["cluster"].tolist() == [0, 1, 0]
    state = centroids.assign_rows(history[:2], v, state)
    assert state["cluster"].tolist() == [1, 0, 0]
    assert centroids.assign_rows(history, v, state)["cluster"].tolist() == [0, 0, 0]


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [[float(x) for x in rng.normal(0, 1, 64)] for _ in range(30)]
    rows = [(i, v) for i, v in enumerate(good)] + [(None, good[0]), (None, good[5]), (3, good[3]), (4, good[9]), (50, None), (51, []), (52, good[0][:63])]
    rows += [(53, [*good[0][:63], None]), (54, [*good[0][:63], float("nan")]), (55, [*good[0][:63], float("inf")]), (56, [0.0] * 64), (57, [1e6] * 64), (58, [-3e5] * 64)]
    docs = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, v string, distance double")
    assert got(centroids.cluster(docs)) == plain(rows)[0]
    assert centroids.cluster(docs.limit(0)).collect() == []
    assert centroids.cluster(docs.where("vec_id = 51")).columns == COLUMNS
    # beyond exact longs: Python's integers, and the largest long where a result does not fit
    far = [*rows[:5], (60, [4e15] * 64), (61, [-4e15] * 64)]
    assert got(centroids.cluster(spark.createDataFrame(far, "vec_id bigint, embedding array<double>"), k=2)) == plain(far, k=2)[0]


def test_one_vector_many_times(spark):
    rows = [(i, [1.5] * 64) for i in range(500)] + [(1000 + i, [float(i)] * 64) for i in range(50)]
    assert got(centroids.cluster(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))) == plain(rows)[0]
