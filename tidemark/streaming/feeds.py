"""Change feeds and counts as Structured Streaming jobs.

All run with ``availableNow``: an outside schedule starts them, they take what has arrived
since their checkpoint and stop. One query per checkpoint folder keeps runs from overlapping.

Nothing is dropped for being late: replays are found by key among the rows that were landed, and counts are landed as
partial counts per micro-batch and added up on reading. What a stream lands is filed under its own id, which a new
checkpoint folder changes, so the batches after a lost checkpoint never pass for those before it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..plans.index_table import IndexTable
from ..session import cut
from .keys import KEYS_PER_BUCKET, KeyStore


def read_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_batches(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Take all waiting input through ``write(batch, batch_id)``, then stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return query


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that a checkpoint folder belongs to."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


_BATCH = T.StructType([T.StructField("stream", T.StringType()), T.StructField("batch_id", T.LongType())])


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What streams have landed, with ``stream`` and ``batch_id``."""
    return spark.read.schema(T.StructType([*schema.fields, *_BATCH.fields])).parquet(path)


def land_batches(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    shape: Callable[[DataFrame, DataFrame], DataFrame] = lambda batch, landed: batch,
) -> DataFrame:
    """Land each micro-batch in a folder of its own, so that a repeated batch replaces itself.

    ``shape`` gets a batch and what all other batches have landed, and gives the rows to land; their columns must
    be those of ``shape(batch, batch)``. Returns all that is landed now.
    """
    spark = stream.sparkSession
    empty = spark.createDataFrame([], stream.schema)
    schema = shape(empty, empty).schema
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/stream=none/batch_id=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        own = stream_id(batch.sparkSession, checkpoint)
        others = read_batches(batch.sparkSession, path, schema).where(
            ~((F.col("stream") == own) & (F.col("batch_id") == batch_id))
        )
        shape(batch, others).write.mode("overwrite").parquet(f"{path}/stream={own}/batch_id={batch_id}")

    run_batches(stream, write, checkpoint)
    return read_batches(spark, path, schema)


def land_new(
    stream: DataFrame, key: str, path: str, checkpoint: str, keys: str | None = None, keys_per_bucket: int = KEYS_PER_BUCKET
) -> DataFrame:
    """Land each key once, however late it comes and however often; returns all landed rows.

    Landed keys are found in a ``KeyStore`` beside the rows (``keys``, by default the path with ``.keys``): a batch opens the
    buckets of its own keys, not all that is landed. A batch's rows land before its keys are stored; at the start of a run the keys of
    batches that a job left without are added from their rows. Rows without a key are all kept.
    """
    spark, schema = stream.sparkSession, stream.schema
    store = KeyStore(spark, keys or f"{path}.keys", schema[key].dataType, keys_per_bucket)
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/stream=none/batch_id=-1")
    landed = read_batches(spark, path, schema)
    missing = landed.select("stream", "batch_id").distinct().join(store.batches(), ["stream", "batch_id"], "left_anti")
    for r in missing.collect():  # those of the last job that died, as a rule none; all where a store is built for an older table
        own = landed.where((F.col("stream") == r["stream"]) & (F.col("batch_id") == r["batch_id"]) & F.col(key).isNotNull())
        store.add(own.select(F.col(key).alias("key")), r["stream"], r["batch_id"])

    def write(batch: DataFrame, batch_id: int) -> None:
        own = stream_id(batch.sparkSession, checkpoint)
        keyed = cut(batch.where(F.col(key).isNotNull()).dropDuplicates([key]), "batch")
        known = store.known(keyed.select(F.col(key).alias("key")), own, batch_id).withColumnRenamed("key", key)
        fresh = cut(keyed.join(known, key, "left_anti").select(*batch.columns), "fresh")
        rows = fresh.unionByName(batch.where(F.col(key).isNull()))
        rows.write.mode("overwrite").parquet(f"{path}/stream={own}/batch_id={batch_id}")
        store.add(fresh.select(F.col(key).alias("key")), own, batch_id)

    run_batches(stream, write, checkpoint)
    return read_batches(spark, path, schema)


def window_counts(rows: DataFrame, keys: list[str], ts: str, width: str) -> DataFrame:
    """Rows per window and key; counts are combined in each task before the shuffle."""
    return (
        rows.groupBy(F.window(ts, width).alias("window"), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n")
    )


def land_counts(stream: DataFrame, keys: list[str], ts: str, width: str, path: str, checkpoint: str) -> DataFrame:
    """Count a stream per window and key, late rows included; returns the counts so far.

    Each batch lands its own partial counts. After a lost checkpoint the stream reads its input anew, so only the
    counts of the stream that owns the checkpoint are added up.
    """
    landed = land_batches(stream, path, checkpoint, lambda batch, _: window_counts(batch, keys, ts, width))
    mine = landed.where(F.col("stream") == stream_id(stream.sparkSession, checkpoint))
    return mine.groupBy("window_start", "window_end", *keys).agg(F.sum("n").alias("n"))


def newest_changes(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One change per key, the last by ``order``; ties go to the greatest row, so a repeat chooses alike."""
    rest = [c for c in batch.columns if c not in (*keys, *order)]
    return batch.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_last")).select(*keys, "_last.*").select(*batch.columns)


def tick_calendar(counts: DataFrame, expected: DataFrame, every: str, until: dt.datetime | None = None) -> DataFrame:
    """``(owner, expected, window_start, window_end)``: every tick at which an owner is checked, whether rows came or not.

    An owner is checked from its first window on (one that never delivered from the first of all), or from a column
    ``since`` of ``expected``, up to the tick that holds ``until`` or the newest window of any owner. A tick is as long as
    the windows of ``counts``. Rows follow the owners' own spans: the ticks are spread out owner by owner, and no counts are read twice.
    """
    tick = F.expr(f"INTERVAL {every}")
    span = counts.agg(F.min("window_start").alias("first"), F.max("window_start").alias("last")).first()  # one row
    if until is None and span["last"] is None:
        return expected.select("owner", "expected", *[F.lit(None).cast("timestamp").alias(f"window_{s}") for s in ("start", "end")]).limit(0)
    firsts = counts.groupBy("owner").agg(F.min("window_start").alias("_first"))
    last = F.lit(span["last"]) if until is None else F.window(F.lit(until), every)["start"]
    begin = F.coalesce("_first", F.lit(span["first"]), last)
    if "since" in expected.columns:
        begin = F.coalesce("since", begin)
    ticks = F.when(begin <= last, F.sequence(begin, last, tick)).otherwise(F.array().cast("array<timestamp>"))
    return (
        expected.join(firsts, "owner", "left")
        .select("owner", "expected", F.explode(ticks).alias("window_start"))
        .withColumn("window_end", F.col("window_start") + tick)
    )


def window_drift(counts: DataFrame, expected: DataFrame, every: str | None = None, until: dt.datetime | None = None) -> DataFrame:
    """Windows with their count, the expected one, and whether they differ, per owner.

    With ``every``, the length of the windows, each tick of ``tick_calendar`` is judged, so an owner that
    falls silent, or never delivered at all, drifts. Without it only windows that hold rows are. Nothing is
    expected of an owner whose expected count is 0: its check is skipped, and ``drift`` is null.
    """
    if every is None:
        joined = counts.join(expected, "owner")
    else:
        ticks = tick_calendar(counts, expected, every, until)
        joined = ticks.join(counts.drop("window_end"), ["owner", "window_start"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return joined.withColumn("drift", F.when(F.col("expected") != 0, F.col("n") != F.col("expected")))


def drift_flags(windows: DataFrame) -> DataFrame:
    """Per owner: the flag after the newest window that was checked, and the last time drift was seen."""
    checked = F.when(F.col("drift").isNotNull(), F.col("window_end"))
    return windows.groupBy("owner").agg(
        F.coalesce(F.max_by("drift", checked), F.lit(False)).alias("drift_flag"),
        F.max(F.when(F.col("drift"), F.col("window_end"))).alias("last_detected"),
    )


def carried_flags(windows: DataFrame) -> DataFrame:
    """Add ``drift_flag``, the flag after each window: a skipped check leaves it as it was. An owner's ticks meet in one task."""
    so_far = Window.partitionBy("owner").orderBy("window_end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return windows.withColumn("drift_flag", F.coalesce(F.last("drift", ignorenulls=True).over(so_far), F.lit(False)))


def apply_stream(
    changes: DataFrame,
    table: IndexTable,
    checkpoint: str,
    writer: str,
    to_documents: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
) -> StreamingQuery:
    """Apply a stream of changes to an index, once per batch even when a batch is repeated.

    ``to_documents`` splits a batch into documents to put and ``(index_name, doc_id)`` to remove. Where a batch may hold
    several changes of one document, reduce it by ``newest_changes`` or give both frames a ``_seq``.
    Batch numbers count within one checkpoint: after a lost one all input is applied anew, and
    rows that arrived meanwhile with it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        upserts, deletes = to_documents(batch)
        own = f"{writer}/{stream_id(batch.sparkSession, checkpoint)}"
        table.apply(upserts=upserts, deletes=deletes, writer=own, batch_id=batch_id)

    return run_batches(changes, write, checkpoint)
