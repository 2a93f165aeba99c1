"""What the registered queries read: ledgers, reviews, tracks and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import detect, intervals, matching, tracks
from tidewatch.plans import fixtures
from tidewatch.sources import lens
from tidewatch.sources.shared import place, settled, written

__all__ = ["DAY", "NOW", "deterministic", "events", "labels", "made_tracks", "outages", "path_matches", "place", "reasons", "reviews", "runs", "settled", "spans", "stored_tracks", "written"]

NOW = 1_704_175_200_000_000
DAY = 86_400_000_000


def outages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixtures.OUTAGES, "key string, opened_us long, closed_us long")


def reasons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixtures.REASONS, "key string, opened_us long, closed_us long, reason string")


def runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixtures.RUNS, "key string, started_us long, stopped_us long, last_message_us long")


def events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixtures.EVENTS, "event_id string, kind string, mmsi string, ts_us long, lat double, lon double")


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixtures.LABELS, "event_id string, source string, source_confidence string, event_type string, mmsi string, counterpart_mmsi string, ts_us long, lat double, lon double, retrieved_us long")


def spans(spark: SparkSession) -> DataFrame:
    return intervals.observed(runs(spark), outages(spark), NOW)


def made_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.summaries(lens.positions(spark, sf_dir))


def stored_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """made_tracks(), written once for what reads them several times."""
    return written(made_tracks(spark, sf_dir))


def deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of the four detectors that need no fitted model, one for each id, written once for all that read them."""
    return settled(spark, lambda: detect.all_incidents(lens.positions(spark, sf_dir), outages(spark)))


def path_matches(spark: SparkSession, sf_dir: str, made: DataFrame | None = None) -> DataFrame:
    """The events' tracks by whole paths; made are the tracks, if they are at hand."""
    p = lens.positions(spark, sf_dir)
    return matching.event_matches_by_path(events(spark), tracks.summaries(p) if made is None else made, p, spans(spark))


def reviews(made: DataFrame) -> DataFrame:
    """A review ledger that follows from the tracks: labels and ages by the second a track starts in."""
    h = F.expr("start_us div 1000000 % 10").alias("h")
    rows = made.select("track_id", F.expr("start_us div 1000000 % 100000").cast("int").alias("queue_order"), h).where("h < 6")
    first = rows.withColumns({
        "review_id": F.concat(F.lit("queue-v1:"), "track_id"), "reviewer_id": F.lit("primary"), "stratum": F.when(F.col("h") % 2 == 0, "alert").otherwise("rest"),
        "label": F.element_at(F.array(*[F.lit(x) for x in ("normal", "ais_data_artifact", "uncertain", "suspicious", "normal")]), F.least(F.col("h") + 1, F.lit(5)).cast("int")),
        "reviewed_us": F.when(F.col("h") < 5, F.lit(NOW) - (F.col("h") + 1) * DAY),
    })
    again = first.where("h IN (1, 2)").withColumns({"review_id": F.concat(F.lit("queue-v1-rereview:"), "track_id"), "reviewer_id": F.lit("primary-rereview"), "label": F.when(F.col("h") == 1, F.col("label")).otherwise("normal"), "reviewed_us": F.lit(NOW)})
    return first.unionByName(again).withColumn("label", F.when(F.col("reviewed_us").isNotNull(), F.col("label"))).drop("h")
