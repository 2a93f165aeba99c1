"""Tables in the folder that all executors share: what jobs write between their steps, so that they outlive lost executors."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
BATCH_ROWS = 1_000
MOST_SLICES = 16
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session on this one machine may do without and gets one of its own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and context._jsc.sc().getCheckpointDir().isDefined():
        named = context._jsc.sc().getCheckpointDir().get()
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(named)
    return named


def place(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark)}/tables/{uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def written(rows: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows from a table in the shared folder, so that what reads them twice computes them once; what was shuffled for it is deleted."""
    spark, path = rows.sparkSession, path or place(rows.sparkSession)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(rows.schema).parquet(path)


def counted(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of a few bytes a row: to be broadcast up to most rows, and joined by shuffle beyond."""
    return F.broadcast(keys) if keys.count() <= most else keys


def small_batches(spark: SparkSession) -> None:
    """Rows that hold arrays become many Python objects: workers take at most BATCH_ROWS of them at a time, so that what one holds doesn't grow with the input."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a small file in one step: beside its place first, then renamed over what stands there."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    final, draft = fs_path(path), fs_path(f"{path}.{uuid4().hex}.tmp")
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(draft, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if not fs.rename(draft, final):  # some stores don't rename onto a file
        fs.delete(final, False)
        if not fs.rename(draft, final):
            raise OSError(f"{path} couldn't be put in its place")


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of tables, wherever Spark's file systems reach; a missing one is no error."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows that make() returns, written; the tables that were written on the way to them are removed. So steps in a row hold the disk of one of them."""
    path = place(spark)
    with scope(spark):
        return written(make(), path)


def slices(rows: int, most: int) -> int:
    """Into how many slices of about most rows to divide so many."""
    return max(1, min(MOST_SLICES, -(-rows // most)))


def sliced(n: int, key: Column, make: Callable[[Callable[[DataFrame], DataFrame]], DataFrame]) -> DataFrame:
    """make(part) of n slices together, where part(rows) are the rows whose key, a number, falls to the slice; make must keep keys apart.

    Slices are written one after the other, so that the disk holds what one of them shuffles; a single one isn't written.
    """
    if n == 1:
        return make(lambda rows: rows)
    return reduce(DataFrame.unionByName, [written(make(lambda rows, k=k: rows.where(F.pmod(key, F.lit(n)) == k))) for k in range(n)])


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Within it, tables written between steps are noted and removed at its end, when the results have been stored elsewhere."""
    _scopes.append([])
    try:
        yield
    finally:
        removed(spark, *_scopes.pop())
