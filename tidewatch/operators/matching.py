"""Attribution of incidents and external events to tracks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.functions.geo import EARTH_KM, haversine_km
from tidewatch.operators.labels import raw_imo
from tidewatch.operators.overlap import days, few
from tidewatch.sources.shared import written

DAY_US = 86_400_000_000


def _band(lat: Column, km: float) -> Column:
    """The belt of latitude, as wide as km, in which a point lies; points within km lie in the same or a neighbouring belt."""
    return F.floor(lat / F.lit(math.degrees(km * 1.001 / EARTH_KM)))


def _around(rows: DataFrame, lat: str, km: float) -> DataFrame:
    """Each row once for its own belt and its two neighbours."""
    return rows.withColumn("band", F.explode(F.sequence(_band(F.col(lat), km) - 1, _band(F.col(lat), km) + 1)))


def incident_tracks(incidents: DataFrame, tracks: DataFrame) -> DataFrame:
    """(incident_id, track_id, overlap_us): the track of the vessel that overlaps an incident longest; ties to the larger id.

    An incident that has a track_id of its own keeps it, whether or not there is such a track; its overlap is null then.
    """
    t = tracks.select("mmsi", "track_id", "start_us", "end_us")
    known = None
    if "track_id" in incidents.columns:
        has = F.coalesce(F.col("track_id") != "", F.lit(False))
        known = incidents.where(has).select("incident_id", "track_id", F.lit(None).cast("long").alias("overlap_us"))
        incidents = incidents.where(~has)
    rows = incidents.select("incident_id", "mmsi", "ts_start_us", "ts_end_us").join(t, "mmsi").where("start_us <= ts_end_us AND end_us >= ts_start_us")
    overlap = F.least("end_us", "ts_end_us") - F.greatest("start_us", "ts_start_us")
    best = rows.withColumn("overlap_us", overlap).groupBy("incident_id").agg(F.max(F.struct("overlap_us", "track_id")).alias("m"))
    found = best.select("incident_id", "m.track_id", "m.overlap_us")
    return found if known is None else known.unionByName(found)


def event_matches(events: DataFrame, tracks: DataFrame, hours: int = 24, km: float = 25, ratio: float = 2.0) -> DataFrame:
    """event_id, track_id, rank_value, status for each event: its candidates, or one row without a track.

    Candidates are the named vessel's tracks within hours, or else any track within hours and
    km of its end points; events meet tracks by day, and by vessel or belt of latitude. The
    nearest is matched unless a second is within ratio, which makes all ambiguous.
    """
    limit = hours * 3_600_000_000
    t = days(tracks.select("track_id", F.col("mmsi").alias("t_mmsi"), (F.col("start_us") - limit).alias("from_us"), (F.col("end_us") + limit).alias("to_us"), "start_us", "end_us", "start_lat", "start_lon", "end_lat", "end_lon"), "from_us", "to_us").drop("from_us", "to_us")
    e = events.withColumn("day", F.floor(F.col("ts_us") / DAY_US))
    own = e.where("mmsi IS NOT NULL").withColumn("t_mmsi", F.col("mmsi")).join(t, ["day", "t_mmsi"])
    ends = t.withColumn("band", F.explode(F.array_distinct(F.array(_band(F.col("start_lat"), km), _band(F.col("end_lat"), km)))))
    rows = own.unionByName(_around(e, "lat", km).join(ends, ["day", "band"]).drop("band")).dropDuplicates(["event_id", "track_id"]).withColumn("away_us", F.greatest(F.lit(0), F.col("start_us") - F.col("ts_us"), F.col("ts_us") - F.col("end_us")))
    near = F.least(haversine_km(F.col("lat"), F.col("lon"), F.col("start_lat"), F.col("start_lon")), haversine_km(F.col("lat"), F.col("lon"), F.col("end_lat"), F.col("end_lon")))
    named = F.coalesce(F.col("mmsi") == F.col("t_mmsi"), F.lit(False))
    rows = rows.withColumns({"km": near, "named": named}).where((F.col("away_us") <= limit) & (F.col("named") | (F.col("km") <= km)))
    rows = rows.withColumn("rank_value", F.round(F.col("away_us") / F.lit(DAY_US) + F.coalesce(F.col("km") / km, F.lit(0.0)), 6))
    w = W.partitionBy("event_id")
    rows = rows.withColumn("any_named", F.max(F.col("named").cast("int")).over(w)).where("named OR any_named = 0")
    order = w.orderBy("rank_value", "track_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumns({"first": F.first("rank_value").over(order), "second": F.nth_value("rank_value", 2).over(order), "k": F.row_number().over(w.orderBy("rank_value", "track_id"))})
    unclear = F.coalesce(F.col("second") <= ratio * F.greatest("first", F.lit(1e-9)), F.lit(False))
    kept = rows.withColumn("status", F.when(unclear, "ambiguous").otherwise("matched")).where("status = 'ambiguous' OR k = 1").select("event_id", "track_id", "rank_value", "status")
    rest = events.join(kept.select("event_id").distinct(), "event_id", "left_anti").select("event_id", F.lit(None).cast("string").alias("track_id"), F.lit(None).cast("double").alias("rank_value"), F.lit("unmatched").alias("status"))
    return kept.unionByName(rest)


def event_matches_by_path(events: DataFrame, tracks: DataFrame, positions: DataFrame, observed: DataFrame, hours: int = 24, km: float = 25, ratio: float = 2.0, lasts: int = 6) -> DataFrame:
    """event_id, track_id, rank_value, status, in_observed_coverage of each event.

    As event_matches, but an event lasts some hours, its distance to a track is the least to the
    vessel's reports in the window around it or the track's end points, events outside all
    observed spans (start_us, end_us) match nothing, and a named vessel's events match no other.
    Events may name a vessel by imo alone, where positions carry one or their raw message does.
    Events meet reports by day and vessel, or by day and belt of latitude where they name none;
    only the least distance of an event and vessel is kept. Few events are broadcast once they are counted, so that reports stay where they are.
    """
    beside = lambda rows: F.broadcast(rows) if few(rows) else rows
    limit = hours * 3_600_000_000
    e = events if "imo" in events.columns else events.withColumn("imo", F.lit(None).cast("string"))
    e = e.select("event_id", "mmsi", "imo", F.col("ts_us").alias("from_us"), (F.col("ts_us") + lasts * 3_600_000_000).alias("to_us"), F.col("lat").alias("e_lat"), F.col("lon").alias("e_lon"))
    spans = observed.select(F.col("start_us").alias("s_us"), F.col("end_us").alias("t_us"))
    seen = e.join(F.broadcast(spans) if few(spans) else spans, (F.col("from_us") < F.col("t_us")) & (F.col("to_us") > F.col("s_us")), "left_semi")
    windows = written(days(seen.withColumns({"lo": F.col("from_us") - limit, "hi": F.col("to_us") + limit}), "lo", "hi"))
    p = positions if "imo" in positions.columns else positions.withColumn("imo", raw_imo(F.col("raw")) if "raw" in positions.columns else F.lit(None).cast("string"))
    p = p.select(F.col("mmsi").alias("t_mmsi"), "us", "lat", "lon", "imo", F.floor(F.col("us") / DAY_US).alias("day"))
    inside = F.col("us").between(F.col("lo"), F.col("hi"))
    by_imo = beside(windows.where("mmsi IS NULL AND imo IS NOT NULL").select("event_id", "lo", "hi", "day", "imo")).join(p.where("imo IS NOT NULL"), ["day", "imo"]).where(inside).select("event_id", "t_mmsi")
    ids = seen.where("mmsi IS NOT NULL").select("event_id", F.col("mmsi").alias("t_mmsi")).union(by_imo).distinct().withColumn("named", F.lit(True))
    known = ids.select("event_id").distinct().withColumn("known", F.lit(True))
    own = beside(written(windows.drop("mmsi", "imo").join(ids.drop("named"), "event_id")))
    free = beside(_around(windows.join(known, "event_id", "left_anti").drop("mmsi", "imo"), "e_lat", km))
    away_km = haversine_km(F.col("e_lat"), F.col("e_lon"), F.col("lat"), F.col("lon"))
    to_named = own.join(p.drop("imo"), ["day", "t_mmsi"]).where(inside).select("event_id", "t_mmsi", away_km.alias("d"))
    to_free = free.join(p.drop("imo").withColumn("band", _band(F.col("lat"), km)), ["day", "band"]).where(inside).select("event_id", "t_mmsi", away_km.alias("d")).where(F.col("d") <= km)
    paths = to_named.union(to_free).groupBy("event_id", "t_mmsi").agg(F.min("d").alias("path_km"))
    t = tracks.select("track_id", F.col("mmsi").alias("t_mmsi"), "start_us", "end_us", "start_lat", "start_lon", "end_lat", "end_lon")
    whole = seen.drop("mmsi", "imo").withColumns({"lo": F.col("from_us") - limit, "hi": F.col("to_us") + limit})
    by_vessel = whole.join(ids.drop("named").unionByName(paths.drop("path_km")).distinct(), "event_id").join(t, "t_mmsi")
    by_end = days(t, "start_us", "end_us").withColumn("band", F.explode(F.array_distinct(F.array(_band(F.col("start_lat"), km), _band(F.col("end_lat"), km))))).join(free, ["day", "band"]).drop("day", "band")
    rows = by_vessel.unionByName(by_end).where("end_us >= lo AND start_us <= hi").dropDuplicates(["event_id", "track_id"])
    rows = rows.join(paths, ["event_id", "t_mmsi"], "left").join(ids, ["event_id", "t_mmsi"], "left").join(known, "event_id", "left")
    ends = [haversine_km(F.col("e_lat"), F.col("e_lon"), F.col(f"{x}_lat"), F.col(f"{x}_lon")) for x in ("start", "end")]
    away = F.greatest(F.lit(0), F.col("start_us") - F.col("to_us"), F.col("from_us") - F.col("end_us"))
    rows = rows.withColumn("km", F.least("path_km", *ends)).where(F.col("named") | (F.col("known").isNull() & (F.col("km") <= km)))
    rows = rows.withColumn("rank_value", F.round(away / F.lit(limit) + F.coalesce(F.col("km") / km, F.lit(0.0)), 6))
    w = W.partitionBy("event_id").orderBy("rank_value", "track_id")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumns({"first": F.first("rank_value").over(whole), "second": F.nth_value("rank_value", 2).over(whole), "k": F.row_number().over(w)})
    unclear = F.coalesce(F.col("second") <= ratio * F.greatest("first", F.lit(1e-9)), F.lit(False))
    kept = rows.withColumn("status", F.when(unclear, "ambiguous").otherwise("matched")).where("status = 'ambiguous' OR k = 1").select("event_id", "track_id", "rank_value", "status")
    covered = seen.select("event_id").distinct().withColumn("in_observed_coverage", F.lit(True))
    found = events.select("event_id").join(kept, "event_id", "left").join(covered, "event_id", "left")
    return found.fillna("unmatched", ["status"]).fillna(False, ["in_observed_coverage"])


def corroborated(incidents: DataFrame, events: DataFrame, hours: int = 24, km: float = 25) -> DataFrame:
    """The incidents that an external event of the same detector, vessel, time and place bears out.

    Events that name a vessel meet its incidents and those it is the counterpart in; the
    others meet incidents of the same day and belt of latitude.
    """
    limit = hours * 3_600_000_000
    e = events.select(F.col("kind").alias("detector"), F.col("mmsi").alias("who"), F.col("ts_us").alias("e_us"), F.col("lat").alias("e_lat"), F.col("lon").alias("e_lon"))
    i = incidents.select("incident_id", "detector", "mmsi", "counterpart_mmsi", (F.col("ts_start_us") - limit).alias("lo"), (F.col("ts_end_us") + limit).alias("hi"), "lat", "lon")
    fits = F.col("e_us").between(F.col("lo"), F.col("hi")) & (haversine_km(F.col("lat"), F.col("lon"), F.col("e_lat"), F.col("e_lon")) <= km)
    named = i.withColumn("who", F.explode(F.array_distinct(F.array_compact(F.array("mmsi", "counterpart_mmsi"))))).join(e.where("who IS NOT NULL"), ["detector", "who"]).where(fits).select("incident_id")
    free = _around(e.where("who IS NULL").drop("who"), "e_lat", km).withColumn("day", F.floor(F.col("e_us") / DAY_US))
    others = days(i.withColumn("band", _band(F.col("lat"), km)), "lo", "hi").join(free, ["detector", "day", "band"]).where(fits).select("incident_id")
    return incidents.join(named.union(others).distinct(), "incident_id", "left_semi")
