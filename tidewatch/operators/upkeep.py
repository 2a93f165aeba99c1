"""Keeping the tables: deduplication, upserts, incremental replacement, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def new_positions(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """The batch's reports that the store lacks, one per vessel and instant: the last of the batch wins, the store before it."""
    cols = [c for c in batch.columns if c not in ("mmsi", "us")]
    last = batch.groupBy("mmsi", "us").agg(F.max_by(F.struct(*cols), "id").alias("p")).select("mmsi", "us", "p.*")
    return last.join(stored.select("mmsi", "us"), ["mmsi", "us"], "left_anti").select(*batch.columns)


def vessel_dimension(positions: DataFrame) -> DataFrame:
    """First and last sighting, and what the first report says of a vessel."""
    order = F.struct("us", "id")
    return positions.groupBy("mmsi").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min_by("nav_status", order).alias("first_status"), F.count("*").alias("reports"))


def upserted(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The vessel table after a batch: blanks and zeros are filled, sightings widened."""
    s, f = stored.alias("s"), fresh.alias("f")
    rows = s.join(f, F.col("s.mmsi") == F.col("f.mmsi"), "full_outer")
    fill = lambda c: F.coalesce(F.when(F.col(f"s.{c}").cast("string").isin("", "0", "0.0"), F.lit(None)).otherwise(F.col(f"s.{c}")), F.col(f"f.{c}")).alias(c)
    others = [c for c in stored.columns if c not in ("mmsi", "first_us", "last_us")]
    return rows.select(F.coalesce("s.mmsi", "f.mmsi").alias("mmsi"), F.least("s.first_us", "f.first_us").alias("first_us"), F.greatest("s.last_us", "f.last_us").alias("last_us"), *[fill(c) for c in others])


def dirty_backlog(positions: DataFrame, tracks: DataFrame) -> DataFrame:
    """Vessels with reports after their last track ends, or without a track."""
    newest = positions.groupBy("mmsi").agg(F.max("us").alias("last_us"))
    built = tracks.groupBy("mmsi").agg(F.max("end_us").alias("built_us"))
    return newest.join(built, "mmsi", "left").where("built_us IS NULL OR last_us > built_us")


def replaced(stored: DataFrame, fresh: DataFrame, dirty: DataFrame) -> DataFrame:
    """stored without the incidents that a dirty vessel has a part in, and fresh; of one id the fresh row stays."""
    d = dirty.select(F.col("mmsi").alias("d"))
    kept = stored.join(d, F.col("mmsi") == F.col("d"), "left_anti").join(d, F.col("counterpart_mmsi") == F.col("d"), "left_anti")
    return kept.join(fresh.select("incident_id"), "incident_id", "left_anti").unionByName(fresh)


def pruned(positions: DataFrame, now_us: int, days: int = 21) -> DataFrame:
    """What retention keeps: reports of other sources, and live ones of the last days."""
    return positions.where((F.col("source") != "aisstream") | (F.col("us") >= now_us - days * DAY_US))
