"""The collector's books: micro-batch counters, run and outage ledgers, what a full disk changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.operators import upkeep

WARN_GIB, HARD_GIB = 2.0, 5.0


def batch_counts(batch: DataFrame) -> DataFrame:
    """One row on a micro-batch: reports, distinct vessels, last message."""
    return batch.agg(F.count("*").alias("reports"), F.count_distinct("mmsi").alias("vessels"), F.max("us").alias("last_message_us"))


def flush(batch: DataFrame, stored: DataFrame, vessels: DataFrame, identities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A micro-batch's reports that the store lacks, the vessel table after it, and the vessels to process again."""
    fresh = upkeep.new_positions(batch, stored)
    return fresh, upkeep.upserted(vessels, identities), fresh.select("mmsi").distinct()


def bridged(runs: DataFrame) -> DataFrame:
    """(key, opened_us, closed_us) of the times between one run's end and the next one's start; a run that never
    stopped ended with its last message, or where it started."""
    end = F.coalesce("stopped_us", "last_message_us", "started_us")
    w = W.partitionBy("key").orderBy("started_us")
    rows = runs.withColumn("before", F.lag(end).over(w))
    return rows.where(F.col("before") < F.col("started_us")).select("key", F.col("before").alias("opened_us"), F.col("started_us").alias("closed_us"))


def recovered(runs: DataFrame, outages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledgers after a restart: stale runs end with their last message, their open outages no earlier than they opened.

    Outages carry the run they opened in (run_started_us).
    """
    stale = F.col("stopped_us").isNull()
    at = F.coalesce("last_message_us", "started_us")
    closed = runs.withColumn("status", F.when(stale, "interrupted").otherwise("stopped")).withColumn("stopped_us", F.coalesce("stopped_us", at))
    ends = closed.where("status = 'interrupted'").select("key", F.col("started_us").alias("run_started_us"), F.col("stopped_us").alias("until_us"))
    rows = outages.join(ends, ["key", "run_started_us"], "left")
    return closed, rows.withColumn("closed_us", F.coalesce("closed_us", F.greatest("opened_us", "until_us"))).drop("until_us")


def storage_level(gib: float, warn: float = WARN_GIB, hard: float = HARD_GIB) -> str:
    return "hard" if gib >= hard else "warning" if gib >= warn else "normal"


def cadence_seconds(level: str, seconds: float = 45.0) -> float:
    """The downsampler's cadence: on a full disk only reports that say something new pass."""
    return float("inf") if level == "hard" else seconds
