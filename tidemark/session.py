"""Session helpers: a local session for tests and bench, and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tidemark", cores: str = "8") -> SparkSession:
    """A local session for tests and bench runs; on a cluster, use the session you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can write to, as the session names it.

    Where ``spark.checkpoint.dir`` is unset, a local session gets a temporary folder; on a
    cluster a machine-local folder would lose data with its machine, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        # set earlier through SparkContext.setCheckpointDir
        root = context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="tidemark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")


_run_folder: ContextVar[str | None] = ContextVar("run_folder", default=None)


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """Gather all that is written by ``cut`` inside in one folder and remove it at the end.

    Frames that a run returns may read from there, such as its error rows: use them, or write them
    elsewhere, before the block ends.
    """
    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    token = _run_folder.set(folder)
    try:
        yield folder
    finally:
        _run_folder.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run_folder() -> str | None:
    """The folder of the ``scratch_run`` that the caller is in, if any: what ``cut`` writes lives as long as it."""
    return _run_folder.get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the run's folder or the shared one; nothing is created there yet."""
    return f"{_run_folder.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut", *folders: str) -> DataFrame:
    """Write a frame to the shared folder, in ``folders`` by some of its last columns where asked to, and read it back.

    For frames that several later steps use: they are computed once, a lost executor costs no
    recomputation, and Spark knows the real size when it picks a join.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
