"""Staged tables in the shared checkpoint folder.

A stage that several later jobs read is written once as Parquet in the folder
that ``spark.checkpoint.dir`` names, which every executor and the driver share.
Lost executors then cost a re-read, not a recomputation, and the re-read table
has a known size, so Spark's own threshold decides on broadcasts and adaptive
skew splitting applies to joins on it.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from glossaflow.sources import store

#: Removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: list[tuple[SparkSession, str]] = []
_scope = threading.local()


class Observed:
    """Aggregates of a table that are taken while it is written."""

    def __init__(self, **columns: Column):
        self.columns, self.observation = columns, Observation()

    def values(self) -> dict:
        return self.observation.get


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; where it names none, a temporary one, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="glossaflow-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _paths.append((spark, path))
    for held in getattr(_scope, "open", []):
        held.append((spark, path))
    return path


@contextmanager
def staged_here(drop: bool = True) -> Iterator[list[tuple[SparkSession, str]]]:
    """What this thread stages meanwhile; it goes at the end, or with ``drop_staged``."""
    held: list[tuple[SparkSession, str]] = []
    outer = getattr(_scope, "open", [])
    _scope.open = [*outer, held]
    try:
        yield held
    finally:
        _scope.open = outer
        if drop:
            drop_staged(held)


def drop_staged(held: list[tuple[SparkSession, str]]) -> None:
    for item in held:
        if item in _paths:
            drop_path(*item)
            _paths.remove(item)
    held.clear()


def stage_table(df: DataFrame, name: str, apart: Sequence[str] = (), observed: Observed | None = None) -> DataFrame:
    """Write ``df`` once, in a folder for each value of ``apart``, and return a reader of what was written.

    ``observed`` are sums and counts that the same pass takes along. Nothing reads the shuffle files of the write later, so they go with it.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    schema = df.schema
    if observed:
        df = df.observe(observed.observation, *[c.alias(name) for name, c in observed.columns.items()])
    kept = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*apart).parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept) if kept is not None else spark.conf.unset(CLEANUP)
    staged = spark.read.schema(schema).parquet(path)
    staged._staged_path = path
    return staged


def release(*staged: DataFrame) -> None:
    """Removes tables that ``stage_table`` returned and that nothing will read again."""
    for df in staged:
        path = df.__dict__["_staged_path"]
        drop_path(df.sparkSession, path)
        _paths.remove((df.sparkSession, path))


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":  # of a local folder Hadoop holds a list of all files
        with suppress(OSError):
            store.drop(target.toUri().getPath())
    else:
        fs.delete(target, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _paths:
        if spark.sparkContext._jsc is None:
            return
        try:
            drop_path(spark, path)
        except Exception:  # the JVM may be gone already at exit
            return


def bounded_batches(spark: SparkSession, rows: int = 512, size: int = 8 << 20) -> None:
    """Bound Arrow batches by rows and by bytes, so that very long texts fit a worker.

    Smaller bounds that the session has already are kept.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or int(now) > most:
            spark.conf.set(key, str(most))
