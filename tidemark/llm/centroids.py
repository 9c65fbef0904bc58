"""Centroid clustering with ns-bounds: Lloyd rounds that skip what bounds already decide, with exact integer results.

Vectors become integers, floor(``SCALE`` * x). Each vector keeps an upper bound of the distance to its centroid, and for each group of
centroids a lower bound of the distance to any other centroid of the group, each with the round in which it was evaluated. The
driver keeps the history of all centroids. A bound is loosened by the norm of a centroid's total displacement since the
round of evaluation, which is never more than the sum of its drifts per round and often far less, as centroids swing
back and forth. A vector whose upper bound stays below all lower bounds keeps its centroid without a distance; for the others
the bounds that fail are evaluated anew, exactly, and only the groups behind them are scanned.

Results are those of plain rounds, to the last unit: distances are compared as integers, bounds are rounded away from each
other, and only a strict inequality spares a scan, so that ties still go to the smaller number.

Each round is a pass of numpy over Arrow batches, written to the shared folder; the files of the round before are deleted once
the sums of the new one are known. No vector moves between tasks: tasks send back sums and counts per centroid, and the
driver holds centroids (``k`` times the components, per round). A hot vector is no group anywhere.

Defined results: vectors of another length, with a null, or with a component that is not finite are left out, as are null vectors; rows that
repeat count each; a null id counts as the largest hash and comes last among the seeds; seeds that tie in the hash go by their
components; fewer vectors than seeds give as many clusters; no vectors give no rows. Components stop at the range of a long, and
distances and their sums beyond it are given as the largest long; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

K = 40
ROUNDS = 5
WIDTH = 64
SCALE = 256
#: Centroids behind one lower bound.
GROUP = 5
#: Vectors whose distances are worked out at once.
ROWS = 8192
MOST = (1 << 63) - 1
_STATE = "vec_id {kind}, v array<bigint>, cluster int, upper float, upper_at tinyint, lower array<float>, lower_at array<tinyint>, distance bigint, scanned int"


def vectors(df: DataFrame, column: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id and v: the integer form of the vectors that count."""
    # a null component makes the test null, not true
    whole = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    finite = df.select("vec_id", column).where((F.size(column) == width) & whole)
    return finite.select("vec_id", F.transform(column, lambda x: F.floor(scale * x.cast("double"))).alias("v"))


def seeds(found: DataFrame, k: int = K, salt: str = "2") -> np.ndarray:
    """The vectors of the least hashes of their ids, in the order of the hashes."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = found.withColumn("_order", order).orderBy(F.col("_order").asc_nulls_last(), "v").limit(k)
    return np.array([r["v"] for r in first.collect()], np.int64)  # k rows


class _Exact:
    """Squared distances as exact integers: in floats where they fit, in longs, or in Python's integers."""

    def __init__(self, v: np.ndarray, centroids: np.ndarray):
        reach = max(np.abs(a.astype(np.float64)).max(initial=0) for a in (v, centroids))
        kind = np.float64 if reach < 1 << 22 else np.int64 if reach < 1 << 27 else object
        self.v, self.c = v.astype(kind), centroids.astype(kind)
        self.vv, self.cc = (self.v * self.v).sum(1), (self.c * self.c).sum(1)

    def to(self, rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Rows by centroids."""
        return self._whole(self.vv[rows][:, None] - 2 * (self.v[rows] @ self.c[of].T) + self.cc[of][None, :])

    def own(self, rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Each row and its own centroid."""
        d = self.v[rows] - self.c[of]
        return self._whole((d * d).sum(1))

    def _whole(self, d: np.ndarray) -> np.ndarray:
        return d if d.dtype == object else d.astype(np.int64)


def _above(squared: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squared.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def _below(squared: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squared.astype(np.float64)).astype(np.float32), np.float32(-np.inf))


def _displacements(history: np.ndarray) -> np.ndarray:
    """How far each centroid of the last round is from where it was in each round, rounded up."""
    d = history.astype(np.float64) - history[-1].astype(np.float64)
    return np.sqrt((d * d).sum(2)) * (1 + 1e-9)


def assign_rows(history: np.ndarray, v: np.ndarray, state: dict[str, np.ndarray] | None) -> dict[str, np.ndarray]:
    """The new state of some vectors under the last centroids, from their state in the round before (None in the first).

    ``scanned`` counts the centroids whose distance was worked out.
    """
    now, k = len(history) - 1, history.shape[1]
    exact, n, groups = _Exact(v, history[-1]), len(v), [np.arange(g, min(g + GROUP, k)) for g in range(0, k, GROUP)]
    every = np.arange(n)
    if state is None:
        d = exact.to(every, np.arange(k))
        best = d.argmin(1).astype(np.int64)  # of equal ones the first
        squared = d[every, best]
        lower = np.full((n, len(groups)), np.inf, np.float32)
        for g, of in enumerate(groups):
            lower[:, g] = _below(_least_other(d[:, of], of, best))
        at = np.full(n, now, np.int8)
        return {
            "cluster": best, "upper": _above(squared), "upper_at": at, "lower": lower, "lower_at": np.full((n, len(groups)), now, np.int8),
            "distance": squared, "scanned": np.full(n, k, np.int64),
        }
    moved = _displacements(history)
    far = np.stack([moved[:, of].max(1) for of in groups], 1)
    own, upper, upper_at = state["cluster"].copy(), state["upper"].copy(), state["upper_at"].copy()
    lower, lower_at = state["lower"].copy(), state["lower_at"].copy()
    loose = lower.astype(np.float64) - far[lower_at, np.arange(len(groups))[None, :]]
    high = upper.astype(np.float64) + moved[upper_at, own]
    scanned = np.zeros(n, np.int64)
    open_ = np.flatnonzero(high >= loose.min(1))
    # the distance to the own centroid first: it settles many
    squared = exact.own(open_, own[open_])
    scanned[open_] += 1
    upper[open_], upper_at[open_] = _above(squared), now
    best, nearest = own[open_], squared.copy()
    fails = upper[open_].astype(np.float64)[:, None] >= loose[open_]
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for g, of in enumerate(groups):
        rows = np.flatnonzero(fails[:, g])
        if len(rows):
            d = exact.to(open_[rows], of)
            scanned[open_[rows]] += len(of)
            found[g] = rows, d
            at = d.argmin(1)
            value, number = d[np.arange(len(rows)), at], of[at]
            better = (value < nearest[rows]) | ((value == nearest[rows]) & (number < best[rows]))
            best[rows[better]], nearest[rows[better]] = number[better], value[better]
    changed = np.flatnonzero(best != own[open_])
    # the centroid that is left counts for its group again, which may not have been scanned
    left = own[open_[changed]] // GROUP
    whole = open_[changed]
    lower[whole, left] = np.minimum(_low(loose[whole, left]), _below(squared[changed]))
    lower_at[whole, left] = now
    for g, (rows, d) in found.items():
        lower[open_[rows], g] = _below(_least_other(d, groups[g], best[rows]))
        lower_at[open_[rows], g] = now
    own[open_] = best
    upper[whole] = _above(nearest[changed])
    distance = np.empty(n, object if squared.dtype == object else np.int64)
    distance[open_] = nearest
    spared = np.setdiff1d(every, open_)
    distance[spared] = exact.own(spared, own[spared])
    return {"cluster": own, "upper": upper, "upper_at": upper_at, "lower": lower, "lower_at": lower_at, "distance": distance, "scanned": scanned}


def _low(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _least_other(d: np.ndarray, of: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The least distance to a centroid of a group other than the own one."""
    out = d.astype(np.float64)
    out[of[None, :] == best[:, None]] = np.inf
    return out.min(1)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    width = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * width, pa.int32()), pa.array(values.reshape(-1), kind))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _saturated(d: np.ndarray) -> pa.Array:
    return pa.array([min(int(x), MOST) for x in d] if d.dtype == object else d, pa.int64())


def _step(history: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                n, state = batch.num_rows, None
                v = _matrix(batch.column("v"), n)
                if len(history) > 1:
                    state = {c: batch.column(c).to_numpy() for c in ("cluster", "upper", "upper_at")}
                    state |= {c: _matrix(batch.column(c), n) for c in ("lower", "lower_at")}
                new = assign_rows(history, v, state)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id"), _lists(v, pa.int64()), pa.array(new["cluster"], pa.int32()), pa.array(new["upper"], pa.float32()),
                        pa.array(new["upper_at"], pa.int8()), _lists(new["lower"], pa.float32()), _lists(new["lower_at"], pa.int8()),
                        _saturated(new["distance"]), pa.array(new["scanned"], pa.int32()),
                    ],
                    ["vec_id", "v", "cluster", "upper", "upper_at", "lower", "lower_at", "distance", "scanned"],
                )

    return step


def _sums(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task and cluster the number of vectors and the sums of their components, as text."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = [0] * k, [None] * k
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster, v = batch.column("cluster").to_numpy(), _matrix(batch.column("v"), batch.num_rows)
            order = np.argsort(cluster, kind="stable")
            # halves of the bits, so that no sum of a batch overflows
            high, low = v[order] >> 32, v[order] & 0xFFFFFFFF
            which, first = np.unique(cluster[order], return_index=True)
            sizes = np.diff(np.append(first, len(order)))
            parts = zip(which.tolist(), sizes.tolist(), np.add.reduceat(high, first).tolist(), np.add.reduceat(low, first).tolist(), strict=True)
            for c, size, a, b in parts:
                counts[c] += size
                old = totals[c] or [0] * len(a)
                totals[c] = [s + (x << 32) + y for s, x, y in zip(old, a, b, strict=True)]
        has = [c for c in range(k) if counts[c]]
        yield pa.RecordBatch.from_pydict(
            {
                "cluster": pa.array(has, pa.int32()),
                "n": pa.array([counts[c] for c in has], pa.int64()),
                "total": pa.array([[str(s) for s in totals[c]] for c in has], pa.list_(pa.string())),
            }
        )

    return sums


def _update(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of all clusters; an empty one stays."""
    out = centroids.copy()
    parts = state.select("cluster", "v").mapInArrow(_sums(len(centroids)), "cluster int, n bigint, total array<string>")
    totals = parts.select("cluster", "n", F.posexplode("total").alias("at", "total")).groupBy("cluster", "at")
    # a row per cluster and component
    for r in totals.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def rounds(found: DataFrame, centroids: np.ndarray, n_rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[DataFrame]]:
    """The last state (a row per vector), the history of the centroids, and the work of each pass: vectors and distances worked out."""
    spark, history, state, old, work = found.sparkSession, centroids[None], found, None, []
    schema = _STATE.format(kind=found.schema["vec_id"].dataType.simpleString())
    for _ in range(n_rounds + 1):
        path = scratch_path(spark, f"centroids-{len(history)}")
        state.mapInArrow(_step(history), schema).write.parquet(path)
        state = spark.read.schema(schema).parquet(path)
        work.append(state.agg(F.count("*").alias("vectors"), F.sum("scanned").alias("distances")).first())
        if len(history) <= n_rounds:
            history = np.concatenate([history, _update(state, history[-1])[None]])
        if old:
            _delete(spark, old)
        old = path
    return state, history, work


def cluster(embeddings: DataFrame, k: int = K, n_rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 per vector."""
    spark, found = embeddings.sparkSession, vectors(embeddings)
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    centroids = seeds(found, k)
    if not len(centroids):
        return found.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).join(spark.createDataFrame([], schema), "cluster").select(
            "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
        )
    state, history, _ = rounds(found, centroids, n_rounds)
    sums = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1].tolist()]
    total = min(sum(sums.values()), MOST)
    about = spark.createDataFrame([(c, min(s, MOST), total, digest[c]) for c, s in sums.items()], schema)
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def cluster_sql() -> str:
    """The same as DuckDB SQL: plain rounds, one after the other."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH}),
parts AS MATERIALIZED (SELECT r, unnest(range({WIDTH})) AS j, unnest(v) AS x FROM kept),
c0 AS MATERIALIZED (
  SELECT c, unnest(range({WIDTH})) AS j, unnest(v) AS x
  FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept) WHERE c < {K})"""
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""d{i} AS MATERIALIZED (SELECT r, c, CAST(sum((p.x - q.x) * (p.x - q.x)) AS BIGINT) AS d FROM parts p JOIN c{i} q USING (j) GROUP BY r, c),
a{i} AS MATERIALIZED (SELECT r, min(d) AS d, arg_min(c, (d, c)) AS c FROM d{i} GROUP BY r)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""s{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM a{i} JOIN parts USING (r) GROUP BY c, j),
c{i + 1} AS MATERIALIZED (
  SELECT c, j, CAST(CASE WHEN n IS NULL THEN x WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS BIGINT) AS x
  FROM c{i} LEFT JOIN s{i} USING (c, j))"""
            )
    return f"""WITH {", ".join(steps)},
digests AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN digests USING (c)"""
