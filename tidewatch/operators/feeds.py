"""What users of the service read: filtered lists, evidence items, GeoJSON and snapshot documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import zones
from tidewatch.functions.grading import credibility, outage_category, public_id

#: Evidence that may be published; everything else stays inside.
PUBLIC_EVIDENCE = ("duration_minutes", "gap_minutes", "displacement_km", "distance_km", "implied_speed_kn", "partner_count", "point_count")
TITLES = {"gap": "Dark vessel", "spoof": "Implausible track", "loiter": "Loitering vessel", "rendezvous": "Possible transfer at sea", "anomaly": "Unusual voyage"}


def incident_feed(incidents: DataFrame, detector: str | None = None, region: str | None = None, severity: str | None = None, limit: int = 200, full: bool = False) -> DataFrame:
    """The incidents with the highest scores among those asked for, equal ones by id; evidence only where full."""
    rows = incidents
    for name, wanted in (("detector", detector), ("region", region), ("severity", severity)):
        rows = rows if wanted is None else rows.where(F.col(name) == wanted)
    rows = rows if full else rows.drop("evidence")
    return rows.orderBy(F.desc("score"), "incident_id").limit(limit)


def _phrase(detector: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair]), detector), F.col("incident_type"))


def summary(prefix: str = "") -> Column:
    """One sentence on an incident, from its evidence."""
    ev = lambda name: F.coalesce(F.col(f"{prefix}evidence.{name}").cast("string"), F.lit("?"))
    place = F.coalesce(F.concat(F.lit(" in the "), F.col(f"{prefix}evidence.zone")), F.lit(""))
    detail = (
        F.when(F.col("detector") == "gap", F.concat(F.lit(", silent for "), ev("gap_minutes"), F.lit(" min and back "), ev("displacement_km"), F.lit(" km away")))
        .when((F.col("detector") == "rendezvous") & F.col("counterpart_mmsi").isNotNull(), F.concat(F.lit(" with MMSI "), F.col("counterpart_mmsi"), F.lit(" for "), ev("duration_minutes"), F.lit(" min")))
        .when(F.col("detector") == "loiter", F.concat(F.lit(", staying "), ev("duration_minutes"), F.lit(" min")))
        .when(F.col("detector") == "spoof", F.concat(F.lit(", implying "), ev("implied_speed_kn"), F.lit(" kn")))
        .otherwise("")
    )
    return F.concat(_phrase(F.col("detector")), F.lit(": MMSI "), F.col("mmsi"), place, detail, F.lit(". For a person to judge."))


def evidence_feed(incidents: DataFrame, min_score: float = 0.0, region: str | None = None, limit: int = 100) -> DataFrame:
    """Citable evidence items of the incidents with the highest scores, sixteen fields each."""
    rows = incidents.where(F.col("score") >= min_score)
    rows = rows if region is None else rows.where(F.col("region") == region)
    rows = rows.orderBy(F.desc("score"), "incident_id").limit(limit)
    published = F.date_format(F.timestamp_micros("ts_start_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return rows.select(
        F.col("incident_id").alias("doc_id"), F.concat(_phrase(F.col("detector")), F.lit(" - MMSI "), F.col("mmsi")).alias("title"), F.lit("vessel movement reports").alias("source"), "reliability", credibility(F.col("score")).alias("credibility"),
        summary().alias("summary"), published.alias("published"), F.concat(F.lit("/incidents/"), F.col("incident_id")).alias("url"), F.lit("geoint").alias("kind"), "detector", "mmsi", "counterpart_mmsi", "lat", "lon",
        F.col("evidence.zone").alias("zone"), "techniques", "region",
    )


def latest_tracks(tracks: DataFrame, region: str | None = None, limit: int = 300) -> DataFrame:
    """The tracks that started last."""
    rows = tracks if region is None else tracks.where(F.col("region") == region)
    return rows.orderBy(F.desc("start_us"), "track_id").limit(limit)


def _line(points: Column) -> Column:
    return F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))


def _feature(geometry: Column, **properties: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[c.alias(n) for n, c in properties.items()]).alias("properties")))


def track_features(tracks: DataFrame, voyages: DataFrame) -> DataFrame:
    """track_id, feature: a GeoJSON line of each of few tracks with two reports or more; voyages are reports with their voyage."""
    wanted = tracks.select("mmsi", "voyage", "track_id", "region")
    rows = voyages.select("mmsi", "voyage", "us", "id", "lat", "lon").join(F.broadcast(wanted), ["mmsi", "voyage"])
    lines = rows.groupBy("mmsi", "voyage", "track_id", "region").agg(F.sort_array(F.collect_list(F.struct("us", "id", "lon", "lat"))).alias("p")).where(F.size("p") >= 2)
    return lines.select("track_id", _feature(_line(F.col("p")), mmsi=F.col("mmsi"), track_id=F.col("track_id"), region=F.col("region")).alias("feature"))


def vessel_feature(positions: DataFrame, mmsi: str) -> DataFrame:
    """mmsi, points, feature: one vessel's reports as a GeoJSON line; no row without reports."""
    rows = positions.where(F.col("mmsi") == mmsi).groupBy("mmsi").agg(F.sort_array(F.collect_list(F.struct("us", "id", "lon", "lat"))).alias("p"))
    return rows.select("mmsi", F.size("p").alias("points"), _feature(_line(F.col("p")), mmsi=F.col("mmsi"), points=F.size("p")).alias("feature"))


def zone_features(table: DataFrame) -> DataFrame:
    """zone_id, feature: the zones as GeoJSON polygons with closed rings."""
    ring = F.transform("polygon", lambda p: F.array(p[1], p[0]))
    closed = F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    return table.select("zone_id", _feature(shape, zone_id=F.col("zone_id"), name=zones.name_of(F.col("zone_id")), kind=F.col("kind"), sensitive=F.col("sensitive") == 1).alias("feature"))


def freshness(age_minutes: Column) -> Column:
    """live below 10 minutes, delayed up to 30, else offline; nothing heard is offline."""
    return F.when(age_minutes < 10, "live").when(age_minutes <= 30, "delayed").otherwise("collector offline")


def status(runs: DataFrame, outages: DataFrame, spans: DataFrame, now_us: int) -> DataFrame:
    """One row: freshness, last report, observed and calendar hours, and the open outage that opened last, null where none is open."""
    now, hour = F.lit(now_us), F.lit(3.6e9)
    ran = runs.agg(F.max("last_message_us").alias("last_report_us"), F.min("started_us").alias("since_us"), F.count("*").alias("run_count"))
    open_ = outages.where("closed_us IS NULL").agg(F.max_by(F.struct("reason", "opened_us"), "opened_us").alias("o"))
    seen = spans.agg(F.round(F.coalesce(F.sum(F.col("end_us") - F.col("start_us")), F.lit(0)) / hour, 4).alias("observed_hours"))
    one = ran.crossJoin(open_).crossJoin(seen)  # single rows
    age = F.greatest(F.lit(0.0), (now - F.col("last_report_us")) / F.lit(6e7))
    return one.select(
        freshness(age).alias("mode"), "last_report_us", "observed_hours", F.round(F.greatest(F.lit(0), now - F.coalesce("since_us", now)) / hour, 4).alias("calendar_hours"), F.when(F.col("o").isNotNull(), outage_category(F.col("o.reason"))).alias("outage_category"),
        F.round((now - F.col("o.opened_us")) / F.lit(6e7), 1).alias("outage_minutes"), "run_count",
    )


def stats(positions: DataFrame, tracks: DataFrame, incidents: DataFrame, runs: DataFrame, outages: DataFrame, spans: DataFrame, vessel_hours: DataFrame, events: DataFrame, reviews: DataFrame, incident_tracks: DataFrame, now_us: int) -> DataFrame:
    """One row: sizes of the tables, observed time and alert rate, outages, labels by source, and how many tracks and alerts are reviewed.

    A reviewed alert is a track with a finished primary review that some incident belongs to.
    """
    hour, now = F.lit(3.6e9), F.lit(now_us)
    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    tally = lambda rows, key, name: rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias(name))  # noqa: E731  as many as there are detectors or sources
    done = reviews.where((F.col("reviewer_id") == "primary") & F.col("reviewed_us").isNotNull())
    length = F.greatest(F.lit(0), F.coalesce("closed_us", now) - F.col("opened_us"))
    one = positions.agg(F.count("*").alias("accepted_reports"), F.count_distinct("mmsi").alias("vessels"))
    for part in (
        count(tracks, "tracks"), count(incidents, "incidents"), tally(incidents, "detector", "incidents_by_detector"), runs.agg(F.greatest(F.lit(0), F.count("*") - 1).alias("reconnects")),
        outages.agg(F.count("*").alias("outages"), F.round(F.coalesce(F.sum(length), F.lit(0)) / hour, 4).alias("outage_hours")), spans.agg(F.round(F.coalesce(F.sum(F.col("end_us") - F.col("start_us")), F.lit(0)) / hour, 4).alias("observed_hours")),
        vessel_hours.agg(F.round(F.coalesce(F.sum("observed_hours"), F.lit(0.0)), 4).alias("observed_vessel_hours")), tally(events, "source", "labels_by_source"), count(done, "reviewed"),
        count(done.select("track_id").distinct().join(incident_tracks.select("track_id"), "track_id", "left_semi"), "reviewed_alerts"),
    ):
        one = one.crossJoin(part)  # single rows
    rate = F.when(F.col("observed_vessel_hours") > 0, F.round(F.col("incidents") * 100 / F.col("observed_vessel_hours"), 4))
    return one.withColumn("alerts_per_100_vessel_hours", rate)


def incident_states(incidents: DataFrame, incident_tracks: DataFrame, matches: DataFrame, events: DataFrame, reviews: DataFrame, now_us: int, delay_minutes: int = 15, limit: int = 200) -> DataFrame:
    """The latest incidents, under public ids, with what is known of each: reviewed, unresolved, corroborated or candidate.

    A primary review of the incident's track decides first; else a matched external event of
    the track bears it out, if official or of the detector's own type.
    """
    latest = incidents.where(F.col("ts_end_us") <= now_us - delay_minutes * 60_000_000).orderBy(F.desc("ts_start_us"), F.desc("score"), "incident_id").limit(limit).join(incident_tracks.select("incident_id", "track_id"), "incident_id", "left")
    known = matches.where(F.col("track_id").isNotNull() & F.col("status").isin("matched", "ambiguous")).join(events.select("event_id", "source_confidence", "event_type"), "event_id")
    borne = known.groupBy("track_id").agg(F.max((F.col("source_confidence") == "official").cast("int")).alias("official"), F.collect_set("event_type").alias("types"))
    label = reviews.where((F.col("reviewer_id") == "primary") & F.col("reviewed_us").isNotNull()).groupBy("track_id").agg(F.max_by("label", F.struct("reviewed_us", "review_id")).alias("label"))
    rows = latest.join(borne, "track_id", "left").join(label, "track_id", "left")
    borne_out = F.coalesce((F.col("official") == 1) | F.array_contains("types", F.col("detector")), F.lit(False))
    state = F.when(F.col("label") == "uncertain", "unresolved").when(F.col("label").isNotNull(), "reviewed").when(borne_out, "corroborated").otherwise("candidate")
    held = set(incidents.schema["evidence"].dataType.names)
    shown = [(F.col(f"evidence.{c}") if c in held else F.lit(None)).cast("double").alias(c) for c in PUBLIC_EVIDENCE]
    return rows.select(public_id(F.col("incident_id")).alias("public_incident_id"), "detector", F.col("incident_type").alias("type"), F.round("score", 4).alias("score"), F.col("reliability").alias("reliability_grade"), "ts_start_us", state.alias("status"), *shown)


def rollups_with_vessels(rollups: DataFrame, vessels: DataFrame) -> DataFrame:
    """Risk of each vessel with its name, type and flag, the riskiest first; vessels that the dimension lacks stay."""
    return rollups.join(vessels.select("mmsi", "name", "ship_type", "flag"), "mmsi", "left").orderBy(F.desc("risk"), "mmsi")
