"""Reading the input tables and cutting lineage so that jobs outlive lost executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.shared import shared_folder, written

BROADCAST_ROWS = 1_000_000
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20
HOT_ROWS = 20_000  # rows of one key that a task takes before the key is salted


def small_batches(spark: SparkSession) -> None:
    """Texts are long, so Arrow takes fewer rows and bytes at a time than by default: what a worker holds stays small.

    A setting of the session, made by the registered queries and the pipeline's stages alone.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input, for a registered query."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a table written once in the cluster's shared folder; sources.shared.scope removes such tables."""
    return written(df)


def pinned(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions and order, from a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Keys of a few bytes a row, counted: to be broadcast up to most rows, and joined by shuffle beyond."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= most else keys


def hot(rows: DataFrame, key: str, most: int = HOT_ROWS) -> DataFrame:
    """(key, parts) of the keys that more than most rows have; there are at most the rows by most of them."""
    return cut(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).cast("int").alias("_parts")))


def salted(rows: DataFrame, lookup: DataFrame, key: str, spread: Column, parts: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined to lookup by key. A key of parts (see hot) is dealt to so many tasks by the hash of spread,
    and its row of lookup goes to each of them."""
    parts = F.broadcast(parts)
    left = rows.join(parts, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), "_parts"), F.lit(0))).drop("_parts")
    right = lookup.join(parts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)).cast("long") - 1))).drop("_parts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def looked_up(rows: DataFrame, lookup: DataFrame, key: str, spread: Column, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined to lookup, a written table of a few bytes a row with one row a key: broadcast if counted small, salted beyond."""
    if lookup.count() <= most:
        return rows.join(F.broadcast(lookup), key, how)
    return salted(rows, lookup, key, spread, hot(rows, key), how)
