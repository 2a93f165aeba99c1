"""Interval merging and subtraction, and what follows for observed time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.operators.overlap import overlapping


def merged(rows: DataFrame, key: str = "key") -> DataFrame:
    """(key, start_us, end_us) with overlapping and touching intervals of a key made one."""
    w = W.partitionBy(key).orderBy("start_us", "end_us")
    reach = F.max("end_us").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.where("end_us > start_us").withColumn("fresh", F.when(reach.isNull() | (F.col("start_us") > reach), 1).otherwise(0))
    island = marked.withColumn("island", F.sum("fresh").over(w))
    return island.groupBy(key, "island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("island")


def subtracted(left: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    """The parts of left's merged intervals that no interval of right covers: a sweep over the boundaries."""
    edge = lambda df, kind: df.select(key, F.explode(F.array(F.struct(F.col("start_us").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("at"), F.lit(-1).alias("d")))).alias("x")).select(key, "x.at", *[(F.col("x.d") if k == kind else F.lit(0)).alias(k) for k in ("l", "r")])
    edges = edge(merged(left, key), "l").unionByName(edge(merged(right, key), "r")).groupBy(key, "at").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    w = W.partitionBy(key).orderBy("at")
    swept = edges.select(key, F.col("at").alias("start_us"), F.lead("at").over(w).alias("end_us"), F.sum("l").over(w).alias("inside"), F.sum("r").over(w).alias("out"))
    return merged(swept.where("inside > 0 AND out = 0 AND end_us IS NOT NULL").select(key, "start_us", "end_us"), key)


def observed(runs: DataFrame, outages: DataFrame, now_us: int) -> DataFrame:
    """Merged runs of a collector less its outages; an open outage lasts until now, a running run until its last message."""
    ran = runs.where(F.coalesce("stopped_us", "last_message_us").isNotNull())
    r = ran.select("key", F.col("started_us").alias("start_us"), F.least(F.coalesce("stopped_us", "last_message_us"), F.lit(now_us)).alias("end_us"))
    o = outages.select("key", F.col("opened_us").alias("start_us"), F.least(F.coalesce("closed_us", F.lit(now_us)), F.lit(now_us)).alias("end_us"))
    return subtracted(r, o)


def overlap_hours(tracks: DataFrame, spans: DataFrame) -> DataFrame:
    """Hours of each track inside the observed spans."""
    part = F.greatest(F.lit(0), F.least("end_us", "to_us") - F.greatest("start_us", "from_us"))
    met = overlapping(tracks.select("mmsi", "track_id", "start_us", "end_us"), spans.select(F.col("start_us").alias("from_us"), F.col("end_us").alias("to_us")), "start_us", "end_us", "track_id")
    return met.groupBy("mmsi", "track_id").agg(F.round(F.sum(part) / F.lit(3.6e9), 6).alias("observed_hours"))
