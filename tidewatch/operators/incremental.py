"""Refreshing what new reports change, and only that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import anomaly, detect, tracks, upkeep


def tail(positions: DataFrame, stored: DataFrame, dirty: DataFrame) -> DataFrame:
    """The reports of dirty vessels from the start of each one's latest track on, with that track's number."""
    last = stored.groupBy("mmsi").agg(F.max("start_us").alias("from_us"), F.max("voyage").alias("first_voyage"))
    rows = positions.join(dirty.select("mmsi").distinct(), "mmsi").join(last, "mmsi", "left")
    return rows.where("from_us IS NULL OR us >= from_us").drop("from_us")


def refreshed_tracks(positions: DataFrame, stored: DataFrame, dirty: DataFrame) -> DataFrame:
    """The track table after the dirty vessels' tails were segmented again; a track's id decides what is replaced."""
    rest = tail(positions, stored, dirty)
    base = rest.groupBy("mmsi").agg(F.max(F.coalesce("first_voyage", F.lit(0))).alias("base"))
    fresh = tracks.summaries(rest.drop("first_voyage")).join(base, "mmsi").withColumn("voyage", F.col("voyage") + F.col("base")).drop("base")
    return stored.join(fresh.select("track_id"), "track_id", "left_anti").select(*stored.columns).unionByName(fresh.select(*stored.columns))


def judged_again(positions: DataFrame, dirty: DataFrame, outages: DataFrame | None = None) -> DataFrame:
    """The findings on dirty vessels, one for each id.

    Gaps, kinematics and dwelling need the vessel alone, witnesses come from all vessels.
    Meetings are sought among the dirty vessels and those they share a half hour and cell
    with, which is enough to know how many partners each side of a meeting has.
    """
    own = positions.join(dirty.select("mmsi").distinct(), "mmsi", "left_semi")
    mine = detect.rendezvous(positions, dirty)
    fresh = detect.gaps(own, outages, positions).unionByName(detect.loiters(own)).unionByName(detect.spoofs(own)).unionByName(mine)
    return fresh.groupBy("incident_id").agg(F.max_by(F.struct(*detect.COLUMNS[1:]), F.struct("detector", "ts_end_us", "lat", "lon")).alias("i")).select("incident_id", "i.*")


def refreshed_incidents(positions: DataFrame, stored: DataFrame, dirty: DataFrame, outages: DataFrame | None = None) -> DataFrame:
    """The incident table after the dirty vessels were judged again."""
    return upkeep.replaced(stored, judged_again(positions, dirty, outages), dirty.select("mmsi").distinct())


def refreshed_anomalies(shapes: DataFrame, made: DataFrame, stored: DataFrame, dirty: DataFrame, artifact: str, sha256: str) -> DataFrame:
    """The incident table after the dirty vessels' voyages were scored again by the pinned model; another file is refused, none is ever fitted here."""
    model = anomaly.SequenceModel.load(artifact, sha256)
    d = dirty.select("mmsi").distinct()
    fresh = anomaly.anomalies(shapes.join(d, "mmsi", "left_semi"), made, model)
    old = stored.where("detector = 'anomaly'").join(d, "mmsi", "left_semi").select("incident_id")
    kept = stored.join(old.unionByName(fresh.select("incident_id")).distinct(), "incident_id", "left_anti")
    return kept.unionByName(fresh.select(*stored.columns))
