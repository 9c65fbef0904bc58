"""A store of keys that were seen, in which a batch finds its own without reading the others.

Each landed batch adds a segment: its keys with where they came from, in files by bucket of the key's hash. A segment has as many
buckets as make ``keys_per_bucket`` keys in each, so a bucket stays as small however large the segment. Looking up a batch opens only
the buckets that its keys fall into; once the store is larger than that, what is read per batch depends on the batch alone.

``fan`` segments of one level are merged into one of the next, so there are a few per level, and each key is rewritten once per level. A small table
of segments tells which are there, in how many buckets, and which of these are not empty; it grows by a row per batch.

A segment is written before its row in the table, and merged segments give way in the same write that names the merged one, so a job
that dies leaves the store as it was. One writer at a time, as with the stream itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

KEYS_PER_BUCKET = 50_000
FAN = 8
#: Buckets that a batch may name one by one; a batch that falls into more reads whole segments.
MOST_BUCKETS = 4_096

_SEGMENTS = "segment string, level int, buckets int, filled array<int>, n bigint, replaces array<string>, stream string, batch_id bigint"


class KeyStore:
    def __init__(self, spark: SparkSession, root: str, key_type: T.DataType, keys_per_bucket: int = KEYS_PER_BUCKET, fan: int = FAN):
        self.spark, self.root, self.fan, self.keys_per_bucket = spark, root.rstrip("/"), fan, keys_per_bucket
        self._schema = T.StructType(
            [T.StructField("key", key_type), T.StructField("stream", T.StringType()), T.StructField("batch_id", T.LongType())]
        )
        spark.createDataFrame([], _SEGMENTS).write.mode("ignore").parquet(f"{self.root}/segments")

    def segments(self) -> list:
        """The live segments: a few per level."""
        rows = self.spark.read.schema(_SEGMENTS).parquet(f"{self.root}/segments")
        gone = rows.select(F.explode("replaces").alias("segment"))
        return rows.join(gone, "segment", "left_anti").dropDuplicates(["segment"]).collect()

    def batches(self) -> DataFrame:
        """``(stream, batch_id)`` of all batches that were added."""
        rows = self.spark.read.schema(_SEGMENTS).parquet(f"{self.root}/segments")
        return rows.where("stream IS NOT NULL").select("stream", "batch_id").distinct()

    @staticmethod
    def _bucket(key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _folders(self, keys: DataFrame) -> list[str]:
        """The folders in which the keys may be; at most ``MOST_BUCKETS`` numbers go to the driver."""
        live = [s for s in self.segments() if s["n"]]
        if not live:
            return []
        most = max(s["buckets"] for s in live)
        wanted = [r[0] for r in keys.select(self._bucket(F.col("key"), most)).distinct().limit(MOST_BUCKETS + 1).collect()]
        if len(wanted) > MOST_BUCKETS:
            return [f"{self.root}/keys/segment={s['segment']}" for s in live]
        # numbers of buckets are powers of two, so a key's bucket in a smaller segment follows from the one in the largest
        return [
            f"{self.root}/keys/segment={s['segment']}/bucket={b}" for s in live for b in sorted({w % s["buckets"] for w in wanted} & set(s["filled"]))
        ]

    def candidates(self, keys: DataFrame) -> DataFrame:
        """``(key, stream, batch_id)`` of all stored keys in the buckets of some keys: everything that a lookup reads."""
        folders = self._folders(keys)
        return self._read(folders)

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self._schema)
        rows = self.spark.read.schema(self._schema).option("basePath", f"{self.root}/keys").parquet(*folders)
        return rows.select(*self._schema.names)

    def known(self, keys: DataFrame, stream: str, batch_id: int) -> DataFrame:
        """Those of the keys (a column ``key``) that another batch has added."""
        found = self.candidates(keys)
        others = found.where(~(F.col("stream").eqNullSafe(F.lit(stream)) & F.col("batch_id").eqNullSafe(F.lit(batch_id))))
        return others.select("key").join(keys.select("key"), "key", "left_semi").distinct()

    def add(self, keys: DataFrame, stream: str, batch_id: int) -> None:
        """Add the keys of a batch; the same batch again replaces what it added."""
        rows = keys.select("key", F.lit(stream).alias("stream"), F.lit(batch_id).cast("long").alias("batch_id"))
        earlier = [s["segment"] for s in self.segments() if (s["stream"], s["batch_id"]) == (stream, batch_id)]
        self._write(rows, 0, earlier, stream, batch_id)
        self._merge()

    def _write(self, rows: DataFrame, level: int, replaces: list[str], stream: str | None = None, batch_id: int | None = None) -> None:
        segment = uuid.uuid4().hex
        n = rows.count()
        buckets = 1 << max(0, (n // self.keys_per_bucket).bit_length())
        placed = rows.withColumn("bucket", self._bucket(F.col("key"), buckets))
        filled = []
        if n:
            placed.repartition(min(buckets, 256), "bucket").sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(f"{self.root}/keys/segment={segment}")
            filled = [r[0] for r in self.spark.read.parquet(f"{self.root}/keys/segment={segment}").select("bucket").distinct().collect()]
        row = (segment, level, buckets, filled, n, replaces, stream, batch_id)
        self.spark.createDataFrame([row], _SEGMENTS).coalesce(1).write.mode("append").parquet(f"{self.root}/segments")

    def _merge(self) -> None:
        while True:
            by_level: dict[int, list] = {}
            for s in self.segments():
                by_level.setdefault(s["level"], []).append(s)
            full = [(level, group) for level, group in sorted(by_level.items()) if len(group) >= self.fan]
            if not full:
                return
            level, group = full[0]
            paths = [f"{self.root}/keys/segment={s['segment']}" for s in group if s["n"]]
            self._write(cut(self._read(paths), "merged-keys"), level + 1, [s["segment"] for s in group])
