"""Registered queries of feeds, labels, reviews, books and sources, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import parsing, zones
from tidewatch.functions.geo import heading_delta
from tidewatch.functions.grading import anomaly_score, outage_category
from tidewatch.operators import detect, downsample, evaluate, feeds, figures, fusion, incremental, labels, matching, publish, rebuild, tracks, upkeep
from tidewatch.plans import fixtures, inputs, oracles
from tidewatch.plans.inputs import DAY, NOW, deterministic, made_tracks
from tidewatch.sources import files, lens
from tidewatch.streaming import collector, ledger

CUT = lens.EPOCH_US + 20 * 3_600_000_000
BOX = (1.1, 103.0, 4.0, 104.0)
_EVIDENCE = ("gap_minutes", "displacement_km", "implied_speed_kn", "jump_km", "interval_s", "duration_minutes", "points", "min_range_km", "coverage_verdict", "corridor_support", "corridor_witnessed", "witness_vessels", "endpoint_witnessed", "zone")
_r = lambda c, n=9: F.round(c, n).alias(c)


def _attributed(s: SparkSession, d: str, found: DataFrame) -> DataFrame:
    return matching.incident_tracks(found, made_tracks(s, d))


def _states(s: SparkSession, d: str) -> DataFrame:
    found, made = deterministic(s, d), inputs.stored_tracks(s, d)
    return feeds.incident_states(found, matching.incident_tracks(found, made), inputs.path_matches(s, d, made), inputs.labels(s), inputs.reviews(made), NOW)


def _false_alarms(s: SparkSession, d: str) -> DataFrame:
    found, made = deterministic(s, d), inputs.stored_tracks(s, d)
    return labels.false_alarms(found, matching.incident_tracks(found, made), inputs.reviews(made), lens.vessels(s, d), inputs.spans(s))


def _agreement(s: SparkSession, d: str) -> DataFrame:
    found, made = deterministic(s, d), inputs.stored_tracks(s, d)
    return labels.agreement_by_source(inputs.labels(s), inputs.path_matches(s, d, made), labels.detectors_by_track(found, matching.incident_tracks(found, made)))


def _strata(s: SparkSession, d: str) -> DataFrame:
    """Fixed scores stand in for the model's errors, so that SQL can follow."""
    found, made = deterministic(s, d), inputs.stored_tracks(s, d)
    errors = made.select("mmsi", "voyage", (F.col("max_implied_kn") / 10).alias("error"))
    return evaluate.review_pools(made, matching.incident_tracks(found, made), found, inputs.path_matches(s, d, made), errors, 2.0).select("track_id", "stratum")


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    g = detect.coverage(detect.gap_segments(lens.positions(s, d), inputs.outages(s)), lens.positions(s, d))
    sensitive = zones.is_sensitive(zones.zone_of(F.col("prev_lat"), F.col("prev_lon")))
    base, bonus = F.lit(0.35) + F.when(sensitive, 0.15).otherwise(0.0), F.when(sensitive, 0.1).otherwise(0.0)
    factor = F.when(F.col("verdict") == "vessel-attributed", 1.6).when(F.col("verdict") == "partial", 1.0).otherwise(0.5)
    grade = lambda c: detect.grade(F.round(F.least(F.lit(1.0), c + bonus), 4))
    return figures.verdict_counts(g.withColumns({"before": grade(base), "after": grade(F.least(F.lit(1.0), base * factor))}))


def _rebuilt(s: SparkSession, d: str) -> DataFrame:
    """Tracks stored by region with stale rows; one region is built anew, the other stays."""
    path, made = inputs.place(s), made_tracks(s, d).select("track_id", "mmsi", "region", "point_count")
    stale = made.withColumns({"track_id": F.concat(F.lit("old-"), "track_id"), "point_count": F.lit(0).cast("long")})
    rebuild.replace_partitions(stale.unionByName(stale.withColumn("region", F.lit("elsewhere"))), path, "region")
    rebuild.replace_partitions(made, path, "region")
    return s.read.schema(made.schema).parquet(path).select("track_id", "mmsi", "region", "point_count")


def _found_again(s: SparkSession, d: str) -> DataFrame:
    """Findings stored by region and detector; those of gap and spoof are built anew, the others stay as they were."""
    path, cols = inputs.place(s), ["incident_id", "mmsi", "region", "detector", "score"]
    stored = deterministic(s, d).select(*cols)
    rebuild.replace_partitions(stored.withColumn("score", F.lit(0.0)), path, "region", "detector")
    rebuild.replace_partitions(stored.where(F.col("detector").isin("gap", "spoof")), path, "region", "detector")
    return s.read.schema(stored.schema).parquet(path).select(*cols)


def _csv(s: SparkSession, d: str) -> DataFrame:
    """Reports written as CSV with broken rows between them, read and parsed again."""
    p, path = lens.positions(s, d), inputs.place(s)
    bad = F.col("id") % 7 == 0
    raw = p.select(F.when(F.col("id") % 11 == 0, "  ").otherwise(F.col("mmsi")).alias("MMSI"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("BaseDateTime"), F.when(bad, "n/a").otherwise(F.col("lat").cast("string")).alias("LAT"), F.col("lon").cast("string").alias("LON"), F.col("sog").cast("string").alias("SOG"), F.lit(" tug ").alias("Status"))
    raw.write.option("header", True).csv(path)
    rows = files.within(files.positions(files.report_csv(s, path), "test"), *BOX[:2], *BOX[2:])
    return rows.groupBy("mmsi").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.round(F.sum("sog"), 4).alias("knots"), F.max("nav_status").alias("status"))


def _messages(s: SparkSession, d: str) -> DataFrame:
    """Reports as live messages, some with sentinels or times that can't be read, parsed again."""
    p = lens.positions(s, d)
    when = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("id") % 13 == 0, "").otherwise(".123456789 +0000 UTC"))
    report = F.struct(F.when(F.col("id") % 17 == 0, 102.3).otherwise(F.col("sog")).alias("Sog"), F.lit(360.0).alias("Cog"), F.col("heading").alias("TrueHeading"), F.col("nav_status").alias("NavigationalStatus"))
    meta = F.struct(F.col("mmsi").cast("long").alias("MMSI"), F.col("lat").alias("latitude"), F.when(F.col("id") % 19 == 0, 200.0).otherwise(F.col("lon")).alias("longitude"), when.alias("time_utc"))
    lines = p.select(F.to_json(F.struct(F.lit("PositionReport").alias("MessageType"), meta.alias("MetaData"), F.struct(report.alias("PositionReport")).alias("Message"))).alias("value"))
    return collector.reports(collector.parsed(lines)).groupBy("mmsi").agg(F.count("*").alias("n"), F.count("sog").alias("n_sog"), F.count("cog").alias("n_cog"), F.round(F.sum("sog"), 4).alias("knots"), F.max("us").alias("last_us"))


def _parsed(s: SparkSession, d: str) -> DataFrame:
    k = F.col("id") % 100
    raw = lens.positions(s, d).select("id", "mmsi", F.when(k % 9 == 0, "x").otherwise(k.cast("string")).alias("code"), F.when(k % 8 == 0, "   ").otherwise(F.concat(F.lit(" n"), k.cast("string"), F.lit(" "))).alias("word"), "heading", F.element_at(F.array(*[F.lit(r[3]) for r in fixtures.REASONS], F.lit("no reason")), (F.col("id") % 5 + 1).cast("int")).alias("reason"), "sog")
    return raw.select(
        "id", parsing.number(F.col("code")).alias("number"), parsing.text(F.col("word")).alias("word"), parsing.ship_type(F.col("code")).alias("ship_type"), parsing.flag(F.col("mmsi")).alias("flag"), parsing.below(F.col("heading"), 300).alias("heading"),
        heading_delta(F.col("heading"), F.lit(350.0)).alias("turn"), outage_category(F.col("reason")).alias("category"), F.round(anomaly_score(F.col("sog"), F.lit(4.0)), 9).alias("score"),
    )


def _flushed(s: SparkSession, d: str) -> DataFrame:
    """A micro-batch against the store: per vessel what is new, and the vessel table after it."""
    p = lens.positions(s, d).select("id", "mmsi", F.expr("us div 7200000000").alias("us"))
    seen = lens.positions(s, d).where(F.col("us") < CUT).groupBy("mmsi").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us")).withColumn("name", F.lit(""))
    fresh = lens.positions(s, d).where(F.col("us") >= CUT).groupBy("mmsi").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us")).join(lens.vessels(s, d).select("mmsi", "name"), "mmsi")
    new, vessels, dirty = ledger.flush(p.where("id % 4 <> 0"), p.where("id % 4 = 0"), seen, fresh)
    counts = new.groupBy("mmsi").agg(F.count("*").alias("reports"))
    return vessels.join(dirty.withColumn("dirty", F.lit(1)), "mmsi", "left").join(counts, "mmsi", "left").select("mmsi", "name", "first_us", "last_us", F.coalesce("dirty", F.lit(0)).alias("dirty"), F.coalesce("reports", F.lit(0)).alias("reports"))


def _shape_steps(s: SparkSession, d: str) -> DataFrame:
    rows = tracks.shapes(lens.positions(s, d)).select("mmsi", "voyage", F.posexplode("sequence").alias("at", "s"))
    return rows.select("mmsi", "voyage", F.col("at").cast("long").alias("spot"), F.round(F.col("s")[0], 6).alias("dx"), F.round(F.col("s")[1], 6).alias("dy"), F.round(F.col("s")[2], 6).alias("step_km"))


def _truth(s: SparkSession, d: str) -> DataFrame:
    """Voyages of six reports or more with what the truth says of their vessel; without a truth they are normal."""
    said = inputs.events(s).where("mmsi IS NOT NULL").groupBy("mmsi").agg(F.min("kind").alias("kind"))
    return made_tracks(s, d).where("point_count >= 6").join(said, "mmsi", "left").select("mmsi", "voyage", "point_count", F.coalesce("kind", F.lit("normal")).alias("label"))


Query = Callable[[SparkSession, str], DataFrame]
_PUB = "strftime(make_timestamp(ts_start_us), '%Y-%m-%dT%H:%M:%S.%f')"
_NAMES = "names AS (SELECT * FROM (VALUES " + ", ".join(f"('{z[0]}', '{z[4]}', '{z[1]}')" for z in zones.ZONES) + ") v(zone_id, zone_name, kind))"
_ATT = """att AS (SELECT incident_id, track_id FROM (SELECT incident_id, track_id, row_number() OVER (PARTITION BY incident_id ORDER BY least(end_us, ts_end_us) - greatest(start_us, ts_start_us) DESC, track_id DESC) AS k
  FROM found JOIN tracks ON tracks.mmsi = found.mmsi AND start_us <= ts_end_us AND end_us >= ts_start_us) WHERE k = 1)"""
_KM = oracles._km
_PATHS = f"""seen AS (SELECT e.*, ts_us AS from_us, ts_us + 21600000000 AS to_us FROM ext e WHERE EXISTS (SELECT 1 FROM observed o WHERE e.ts_us < o.end_us AND e.ts_us + 21600000000 > o.start_us)),
paths AS (SELECT s.event_id, p.mmsi, min({_KM('s.lat', 's.lon', 'p.lat', 'p.lon')}) AS km FROM seen s JOIN positions p ON p.us BETWEEN from_us - 86400000000 AND to_us + 86400000000 GROUP BY 1, 2),
reached AS (SELECT s.event_id, s.mmsi AS named, t.mmsi, t.track_id, greatest(0, t.start_us - to_us, from_us - t.end_us) AS away, least(p.km, {_KM('s.lat', 's.lon', 't.start_lat', 't.start_lon')}, {_KM('s.lat', 's.lon', 't.end_lat', 't.end_lon')}) AS km
  FROM seen s JOIN tracks t ON t.end_us >= from_us - 86400000000 AND t.start_us <= to_us + 86400000000 LEFT JOIN paths p ON p.event_id = s.event_id AND p.mmsi = t.mmsi),
ranked AS (SELECT event_id, track_id, round(away / 86400000000.0::DOUBLE + coalesce(km / 25, 0.0), 6) AS rank_value FROM reached WHERE named = mmsi OR (named IS NULL AND km <= 25)),
placed_ AS (SELECT *, row_number() OVER o AS k, first_value(rank_value) OVER o AS first, nth_value(rank_value, 2) OVER (PARTITION BY event_id ORDER BY rank_value, track_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM ranked WINDOW o AS (PARTITION BY event_id ORDER BY rank_value, track_id)),
decided AS (SELECT event_id, track_id, rank_value, CASE WHEN second <= 2.0 * greatest(first, 1e-9) THEN 'ambiguous' ELSE 'matched' END AS status FROM placed_ WHERE coalesce(second <= 2.0 * greatest(first, 1e-9), false) OR k = 1),
matches AS (SELECT e.event_id, d.track_id, d.rank_value, coalesce(d.status, 'unmatched') AS status, s.event_id IS NOT NULL AS in_observed_coverage FROM ext e LEFT JOIN decided d ON d.event_id = e.event_id LEFT JOIN seen s ON s.event_id = e.event_id)"""
_LABELS = f"labels_(event_id, source, source_confidence, event_type, mmsi, counterpart_mmsi, ts_us, lat, lon, retrieved_us) AS (VALUES {oracles._values(fixtures.LABELS)})"
_REVIEWS = f"""aged AS (SELECT track_id, CAST(start_us // 1000000 % 100000 AS INTEGER) AS queue_order, start_us // 1000000 % 10 AS h FROM tracks WHERE start_us // 1000000 % 10 < 6),
firsts AS (SELECT track_id, queue_order, 'queue-v1:' || track_id AS review_id, 'primary' AS reviewer_id, CASE WHEN h % 2 = 0 THEN 'alert' ELSE 'rest' END AS stratum, h, ['normal', 'ais_data_artifact', 'uncertain', 'suspicious', 'normal'][least(h + 1, 5)] AS said, CASE WHEN h < 5 THEN {NOW} - (h + 1) * {DAY} END AS reviewed_us FROM aged),
reviews AS (SELECT track_id, queue_order, review_id, reviewer_id, stratum, CASE WHEN reviewed_us IS NOT NULL THEN said END AS label, reviewed_us FROM firsts
  UNION ALL SELECT track_id, queue_order, 'queue-v1-rereview:' || track_id, 'primary-rereview', stratum, CASE WHEN h = 1 THEN said ELSE 'normal' END, {NOW} FROM firsts WHERE h IN (1, 2))"""
_ALL = (oracles.STEPS, oracles.VOYAGES, oracles.TRACKS, oracles.SILENT, oracles.COVERED, oracles.FOUND)
_ALL_O = (oracles.STEPS, oracles.VOYAGES, oracles.TRACKS, oracles.SILENT.replace("outages(", "outages_(").replace("FROM outages o", "FROM outages_ o"), oracles.COVERED, oracles.FOUND, oracles._OBSERVED)
_with = oracles._with
_TITLE = "CASE detector " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in feeds.TITLES.items()) + " ELSE incident_type END"
_PUBLIC = "CASE detector WHEN 'loiter' THEN minutes WHEN 'rendezvous' THEN minutes END AS duration_minutes, CASE WHEN detector = 'gap' THEN minutes END AS gap_minutes, CASE WHEN detector = 'gap' THEN km END AS displacement_km, CASE WHEN detector IN ('gap', 'spoof') THEN knots END AS implied_speed_kn, NULL::DOUBLE AS distance_km, NULL::DOUBLE AS partner_count, NULL::DOUBLE AS point_count"
_DOWN = oracles.ORACLES["downsample_positions"].replace(">= 1800", ">= 45").replace(">= 120", ">= 20").replace(">= 5)", ">= 2)")
_SHAPES = """pts AS (SELECT mmsi, voyage, us, lat, lon, id, lag(us) OVER w AS p_us, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon FROM voyages WINDOW w AS (PARTITION BY mmsi, voyage ORDER BY us, id)),
long_ AS (SELECT mmsi, voyage, min(us) AS u0, max(us) AS u1, arg_min(lat, (us, id)) AS lat0, arg_min(lon, (us, id)) AS lon0 FROM voyages GROUP BY mmsi, voyage HAVING count(*) >= 6),
ticks AS (SELECT *, CASE WHEN i = 15 THEN u1::DOUBLE ELSE u0 + i * ((u1 - u0) / 15.0::DOUBLE) END AS t FROM long_, range(16) r(i)),
spots AS (SELECT k.mmsi, k.voyage, k.i, lat0, lon0, CASE WHEN i = 0 THEN lat0 ELSE p.p_lat + (p.lat - p.p_lat) * ((t - p.p_us) / (p.us - p.p_us)) END AS lat, CASE WHEN i = 0 THEN lon0 ELSE p.p_lon + (p.lon - p.p_lon) * ((t - p.p_us) / (p.us - p.p_us)) END AS lon
  FROM ticks k JOIN pts p ON p.mmsi = k.mmsi AND p.voyage = k.voyage AND CASE WHEN k.i = 0 THEN p.us = k.u0 AND p.p_us IS NULL ELSE p.us > p.p_us AND k.t > p.p_us AND k.t <= p.us END),
flat_ AS (SELECT mmsi, voyage, i, (lon - lon0) * 111.19 * cos(radians(lat0)) AS x, (lat - lat0) * 111.19 AS y FROM spots),
ends_ AS (SELECT mmsi, voyage, -atan2(arg_max(y, i), arg_max(x, i)) AS a FROM flat_ GROUP BY 1, 2),
turned AS (SELECT f.mmsi, f.voyage, i, cos(a) * x - sin(a) * y AS u, sin(a) * x + cos(a) * y AS v FROM flat_ f JOIN ends_ USING (mmsi, voyage)),
moves AS (SELECT mmsi, voyage, i - 1 AS spot, u - lag(u) OVER w AS dx, v - lag(v) OVER w AS dy FROM turned WINDOW w AS (PARTITION BY mmsi, voyage ORDER BY i))"""
_COORDS = lambda inner: "'[' || string_agg('[' || lon_ || ',' || lat_ || ']', ',' ORDER BY " + inner + ") || ']'"

REVIEWS, ATTRIBUTED = _REVIEWS, _ATT

#: name: (query, SQL)
TABLE: dict[str, tuple[Query, str]] = {
    # feeds
    "incident_evidence": (
        lambda s, d: deterministic(s, d).select("incident_id", *[F.col(f"evidence.{c}").cast("string" if c in ("zone", "coverage_verdict") else "double").alias(c) for c in _EVIDENCE]),
        _with(*_ALL, _NAMES) + """SELECT incident_id, CASE WHEN detector = 'gap' THEN minutes END AS gap_minutes, CASE WHEN detector = 'gap' THEN km END AS displacement_km, CASE WHEN detector IN ('gap', 'spoof') THEN knots END AS implied_speed_kn, CASE WHEN detector = 'spoof' THEN km END AS jump_km, interval_s,
          CASE WHEN detector IN ('loiter', 'rendezvous') THEN minutes END AS duration_minutes, CAST(points AS DOUBLE) AS points, CASE WHEN detector = 'rendezvous' THEN km END AS min_range_km, verdict AS coverage_verdict, round(support, 3) AS corridor_support, CAST(witnessed AS DOUBLE) AS corridor_witnessed, CAST(witnesses AS DOUBLE) AS witness_vessels,
          CAST(ends AS DOUBLE) AS endpoint_witnessed, zone_name AS zone FROM found LEFT JOIN names USING (zone_id)""",
    ),
    "incident_feed": (
        lambda s, d: feeds.incident_feed(deterministic(s, d), "spoof", "singapore", "critical", 50).select("incident_id", "mmsi", "detector", "score", "severity", "ts_start_us", "zone_id"),
        _with(*_ALL) + "SELECT incident_id, mmsi, detector, score, severity, ts_start_us, zone_id FROM found WHERE detector = 'spoof' AND severity = 'critical' ORDER BY score DESC, incident_id LIMIT 50",
    ),
    "evidence_feed": (
        lambda s, d: feeds.evidence_feed(deterministic(s, d), 0.6, "singapore").select("doc_id", "title", "reliability", "credibility", "summary", "published", "url", "zone", F.array_join("techniques", ",").alias("techniques"), "counterpart_mmsi", _r("lat", 6)),
        _with(*_ALL, _NAMES) + f"""SELECT incident_id AS doc_id, {_TITLE} || ' - MMSI ' || mmsi AS title, reliability, CAST({oracles._cut('score', [(0.85, '2'), (0.65, '3'), (0.45, '4'), (0.25, '5')], '6')} AS INTEGER) AS credibility,
          {_TITLE} || ': MMSI ' || mmsi || coalesce(' in the ' || zone_name, '') || CASE detector WHEN 'gap' THEN ', silent for ' || minutes || ' min and back ' || km || ' km away' WHEN 'rendezvous' THEN ' with MMSI ' || other || ' for ' || minutes || ' min'
            WHEN 'loiter' THEN ', staying ' || minutes || ' min' WHEN 'spoof' THEN ', implying ' || knots || ' kn' ELSE '' END || '. For a person to judge.' AS summary,
          {_PUB} AS published, '/incidents/' || incident_id AS url, zone_name AS zone, techniques, other AS counterpart_mmsi, round(lat, 6) AS lat FROM found LEFT JOIN names USING (zone_id) WHERE score >= 0.6 ORDER BY score DESC, incident_id LIMIT 100""",
    ),
    "latest_tracks": (
        lambda s, d: feeds.latest_tracks(made_tracks(s, d), "singapore", 300).select("track_id", "mmsi", "start_us", "point_count"),
        _with(*oracles._BASE) + "SELECT track_id, mmsi, start_us, point_count FROM tracks ORDER BY start_us DESC, track_id LIMIT 300",
    ),
    "vessel_feed": (
        lambda s, d: lens.vessels(s, d).orderBy("mmsi").limit(200),
        _with(lens.VESSELS_SQL) + "SELECT * FROM vessels ORDER BY mmsi LIMIT 200",
    ),
    "track_features": (
        lambda s, d: feeds.track_features(feeds.latest_tracks(made_tracks(s, d), limit=300), tracks.voyages(lens.positions(s, d)).withColumns({c: F.round(c, 6) for c in ("lat", "lon")})),
        _with(*oracles._BASE) + f"""SELECT track_id, '{{"type":"Feature","geometry":{{"type":"LineString","coordinates":' || {_COORDS('us, id')} || '}},"properties":{{"mmsi":"' || mmsi || '","track_id":"' || track_id || '","region":"singapore"}}}}' AS feature
          FROM (SELECT t.track_id, t.mmsi, v.us, v.id, CAST(round(v.lon, 6) AS VARCHAR) AS lon_, CAST(round(v.lat, 6) AS VARCHAR) AS lat_ FROM (SELECT * FROM tracks ORDER BY start_us DESC, track_id LIMIT 300) t JOIN voyages v ON v.mmsi = t.mmsi AND v.voyage = t.voyage) GROUP BY track_id, mmsi HAVING count(*) >= 2""",
    ),
    "vessel_feature": (
        lambda s, d: feeds.vessel_feature(lens.positions(s, d).withColumns({c: F.round(c, 6) for c in ("lat", "lon")}), "563000003"),
        _with() + f"""SELECT mmsi, CAST(count(*) AS INTEGER) AS points, '{{"type":"Feature","geometry":{{"type":"LineString","coordinates":' || {_COORDS('us, id')} || '}},"properties":{{"mmsi":"' || mmsi || '","points":' || count(*) || '}}}}' AS feature
          FROM (SELECT mmsi, us, id, CAST(round(lon, 6) AS VARCHAR) AS lon_, CAST(round(lat, 6) AS VARCHAR) AS lat_ FROM positions WHERE mmsi = '563000003') GROUP BY mmsi""",
    ),
    "track_lines": (
        lambda s, d: publish.lines(tracks.voyages(lens.positions(s, d)), 20),
        _with(*oracles._BASE) + f"""SELECT mmsi, voyage, '{{"type":"Feature","geometry":{{"type":"LineString","coordinates":' || {_COORDS('i')} || '}}}}' AS feature FROM (
          SELECT v.mmsi, v.voyage, s.i, CAST(floor(v.lon * 10000 + 0.5) / 10000.0::DOUBLE AS VARCHAR) AS lon_, CAST(floor(v.lat * 10000 + 0.5) / 10000.0::DOUBLE AS VARCHAR) AS lat_ FROM (SELECT mmsi, voyage, lat, lon, row_number() OVER (PARTITION BY mmsi, voyage ORDER BY us, id) - 1 AS spot, count(*) OVER (PARTITION BY mmsi, voyage) AS n FROM voyages) v
          JOIN range(20) s(i) ON v.spot = CASE WHEN v.n <= 20 THEN s.i ELSE s.i * (v.n - 1) // 19 END WHERE v.n >= 2) GROUP BY mmsi, voyage""",
    ),
    "incident_states": (
        _states,
        _with(*_ALL_O, oracles._EVENTS, _PATHS, _LABELS, _REVIEWS, _ATT) + f""", latest AS (SELECT f.*, a.track_id FROM (SELECT * FROM found WHERE ts_end_us <= {NOW} - 900000000 ORDER BY ts_start_us DESC, score DESC, incident_id LIMIT 200) f LEFT JOIN att a USING (incident_id)),
          borne AS (SELECT track_id, source_confidence, event_type FROM matches JOIN labels_ USING (event_id) WHERE track_id IS NOT NULL AND status IN ('matched', 'ambiguous')), primary_ AS (SELECT track_id, label FROM reviews WHERE reviewer_id = 'primary' AND reviewed_us IS NOT NULL)
          SELECT CAST(sha256(incident_id)[1:12] AS VARCHAR) AS public_incident_id, detector, incident_type AS type, round(score, 4) AS score, reliability AS reliability_grade, ts_start_us, CASE WHEN label = 'uncertain' THEN 'unresolved' WHEN label IS NOT NULL THEN 'reviewed'
            WHEN EXISTS (SELECT 1 FROM borne b WHERE b.track_id = l.track_id AND (b.source_confidence = 'official' OR b.event_type = l.detector)) THEN 'corroborated' ELSE 'candidate' END AS status, {_PUBLIC} FROM latest l LEFT JOIN primary_ p ON p.track_id = l.track_id""",
    ),
    "latest_delayed_tracks": (
        lambda s, d: publish.latest_tracks(made_tracks(s, d), NOW - 6 * 3_600_000_000).select("track_id", "end_us"),
        _with(*oracles._BASE) + f"SELECT track_id, end_us FROM tracks WHERE end_us <= {NOW} - 21600000000 - 900000000 ORDER BY end_us DESC, track_id LIMIT 200",
    ),
    "threat_with_vessels": (
        lambda s, d: feeds.rollups_with_vessels(fusion.fuse(deterministic(s, d)), lens.vessels(s, d)).select("mmsi", "name", "ship_type", "flag", "counterparts", "zones", "first_us", "last_us", "sensitive"),
        _with(*_ALL, lens.VESSELS_SQL) + f"""SELECT mmsi, any_value(name) AS name, any_value(ship_type) AS ship_type, any_value(flag) AS flag, coalesce(string_agg(DISTINCT other, ',' ORDER BY other), '') AS counterparts, coalesce(string_agg(DISTINCT zone_id, ',' ORDER BY zone_id), '') AS zones,
          min(ts_start_us) AS first_us, max(ts_end_us) AS last_us, max(CASE WHEN {oracles._sensitive('zone_id')} THEN 1 ELSE 0 END) AS sensitive FROM found JOIN vessels USING (mmsi) GROUP BY mmsi""",
    ),
    # labels and reviews
    "event_track_match_by_path": (inputs.path_matches, _with(*oracles._BASE, oracles._OBSERVED, oracles._EVENTS, _PATHS) + "SELECT * FROM matches"),
    "request_window": (
        lambda s, d: labels.request_window(lens.positions(s, d)).select("first_date", "until_date", *[_r(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")]),
        _with() + "SELECT CAST(CAST(make_timestamp(min(us)) AS DATE) AS VARCHAR) AS first_date, CAST(CAST(make_timestamp(max(us)) AS DATE) + 1 AS VARCHAR) AS until_date, round(min(lat) - 0.05, 9) AS min_lat, round(max(lat) + 0.05, 9) AS max_lat, round(min(lon) - 0.05, 9) AS min_lon, round(max(lon) + 0.05, 9) AS max_lon FROM positions",
    ),
    "trap_breaches": (
        lambda s, d: labels.trap_breaches(deterministic(s, d), s.createDataFrame(fixtures.TRAPS, "kind string, mmsi string")),
        _with(*_ALL) + f", traps(kind, mmsi) AS (VALUES {oracles._values(fixtures.TRAPS)}) SELECT count(*) AS breaches FROM found WHERE detector = 'gap' AND mmsi IN (SELECT mmsi FROM traps)",
    ),
    "detectors_by_track": (
        lambda s, d: (lambda found: labels.detectors_by_track(found, _attributed(s, d, found)).select("track_id", F.array_join("detectors", ",").alias("detectors")))(deterministic(s, d)),
        _with(*_ALL, _ATT) + "SELECT track_id, string_agg(DISTINCT detector, ',' ORDER BY detector) AS detectors FROM att JOIN found USING (incident_id) GROUP BY track_id",
    ),
    "agreement_by_source": (
        _agreement,
        _with(*_ALL_O, oracles._EVENTS, _PATHS, _LABELS, _ATT) + """, alerted AS (SELECT DISTINCT track_id, detector FROM att JOIN found USING (incident_id)), each_ AS (SELECT l.event_id, source_confidence, source, max(CASE WHEN EXISTS (SELECT 1 FROM alerted a WHERE a.track_id = m.track_id AND (source_confidence = 'official' OR a.detector = event_type)) THEN 1 ELSE 0 END) AS hit
          FROM matches m JOIN labels_ l USING (event_id) WHERE in_observed_coverage AND status IN ('matched', 'ambiguous') AND (source_confidence = 'official' OR event_type IN ('gap', 'rendezvous', 'loiter')) GROUP BY 1, 2, 3) SELECT source_confidence, source, count(*) AS eligible, CAST(sum(hit) AS BIGINT) AS detected FROM each_ GROUP BY 1, 2""",
    ),
    "false_alarms": (
        _false_alarms,
        _with(*_ALL_O, _NAMES, lens.VESSELS_SQL, _REVIEWS, _ATT) + """, calm AS (SELECT track_id FROM reviews WHERE reviewer_id = 'primary' AND label IN ('normal', 'ais_data_artifact')), bad AS (SELECT f.*, n.kind, v.ship_type, EXISTS (SELECT 1 FROM observed o WHERE f.ts_start_us <= o.end_us AND f.ts_end_us >= o.start_us) AS seen
            FROM found f JOIN att USING (incident_id) JOIN calm USING (track_id) LEFT JOIN names n ON n.zone_id = f.zone_id LEFT JOIN vessels v ON v.mmsi = f.mmsi)
          SELECT "grouping", value, count(*) AS n FROM (SELECT 'reliability_grade' AS "grouping", reliability AS value FROM bad UNION ALL SELECT 'zone_kind', coalesce(kind, 'open-strait') FROM bad UNION ALL SELECT 'vessel_type', coalesce(ship_type, 'unknown') FROM bad UNION ALL SELECT 'coverage_state', CASE WHEN seen THEN 'observed' ELSE 'outage-or-unobserved' END FROM bad) GROUP BY 1, 2""",
    ),
    "review_strata": (
        _strata,
        _with(*_ALL_O, oracles._EVENTS, _PATHS, _ATT) + """, alerts AS (SELECT track_id, bool_or(detector IN ('spoof', 'gap')) AS artifact FROM att JOIN found USING (incident_id) GROUP BY track_id)
          SELECT t.track_id, CASE WHEN EXISTS (SELECT 1 FROM matches m WHERE m.track_id = t.track_id AND m.status IN ('matched', 'ambiguous')) THEN 'external-event' WHEN artifact THEN 'ais-artifact-candidate' WHEN a.track_id IS NOT NULL THEN 'alert' WHEN max_implied_kn / 10 BETWEEN 0.8 * 2.0 AND 1.2 * 2.0 THEN 'near-threshold' ELSE 'rest' END AS stratum FROM tracks t LEFT JOIN alerts a USING (track_id)""",
    ),
    "review_progress": (lambda s, d: labels.progress(labels.queued(inputs.reviews(made_tracks(s, d)))), _with(*oracles._BASE, _REVIEWS) + "SELECT reviewer_id, count(*) AS queued, count(reviewed_us) AS done FROM reviews WHERE review_id LIKE 'queue-v1:%' GROUP BY 1"),
    "next_review": (
        lambda s, d: labels.next_items(inputs.reviews(made_tracks(s, d))),
        _with(*oracles._BASE, _REVIEWS) + "SELECT reviewer_id, review_id, track_id, queue_order FROM (SELECT *, row_number() OVER (PARTITION BY reviewer_id ORDER BY queue_order, review_id) AS k FROM reviews WHERE reviewed_us IS NULL) WHERE k = 1",
    ),
    "review_again": (
        lambda s, d: labels.review_again(inputs.reviews(made_tracks(s, d)), NOW),
        _with(*oracles._BASE, _REVIEWS) + f""", old AS (SELECT * FROM reviews WHERE reviewer_id = 'primary' AND reviewed_us <= {NOW} - 3 * {DAY} AND track_id NOT IN (SELECT track_id FROM reviews WHERE reviewer_id = 'primary-rereview')), had AS (SELECT count(*) AS n FROM reviews WHERE reviewer_id = 'primary-rereview')
          SELECT 'queue-v1-rereview:' || lpad(CAST(queue_order AS VARCHAR), 4, '0') AS review_id, track_id, queue_order, stratum, 'primary-rereview' AS reviewer_id FROM (SELECT track_id, stratum, CAST(row_number() OVER (ORDER BY sha256('queue-v1-again' || track_id), track_id) + (SELECT n FROM had) AS BIGINT) AS queue_order, row_number() OVER (ORDER BY sha256('queue-v1-again' || track_id), track_id) AS k FROM old) WHERE k <= greatest(1, round_even((SELECT count(*) FROM old) * 0.15, 0))""",
    ),
    "adjudication": (
        lambda s, d: labels.adjudicated(inputs.reviews(made_tracks(s, d)), made_tracks(s, d).where("start_us % 2 = 0").select("track_id", F.lit("uncertain").alias("label"))),
        _with(*oracles._BASE, _REVIEWS) + """SELECT p.track_id, CASE WHEN p.label = q.label THEN 'agree' WHEN t.start_us % 2 = 0 THEN 'resolved-uncertain' ELSE 'open' END AS adjudication FROM reviews p JOIN reviews q ON q.track_id = p.track_id AND q.reviewer_id = 'primary-rereview' JOIN tracks t ON t.track_id = p.track_id WHERE p.reviewer_id = 'primary' AND p.reviewed_us IS NOT NULL""",
    ),
    "review_agreement": (
        lambda s, d: (lambda r: evaluate.agreement(labels.latest_reviews(r), labels.latest_reviews(r, "primary-rereview")))(inputs.reviews(made_tracks(s, d))),
        _with(*oracles._BASE, _REVIEWS) + "SELECT p.label, count(*) AS n, CAST(sum(CASE WHEN p.label = q.label THEN 1 ELSE 0 END) AS BIGINT) AS agreed FROM reviews p JOIN reviews q ON q.track_id = p.track_id AND q.reviewer_id = 'primary-rereview' WHERE p.reviewer_id = 'primary' AND p.reviewed_us IS NOT NULL GROUP BY 1",
    ),
    "voyage_truth": (_truth, _with(*oracles._BASE, oracles._EVENTS) + "SELECT t.mmsi, voyage, point_count, coalesce(kind, 'normal') AS label FROM tracks t LEFT JOIN (SELECT mmsi, min(kind) AS kind FROM ext WHERE mmsi IS NOT NULL GROUP BY 1) e ON e.mmsi = t.mmsi WHERE point_count >= 6"),
    "shape_steps": (_shape_steps, _with(oracles.STEPS, oracles.VOYAGES, _SHAPES) + "SELECT mmsi, voyage, spot, round(dx, 6) AS dx, round(dy, 6) AS dy, round(sqrt(dx * dx + dy * dy), 6) AS step_km FROM moves WHERE spot >= 0"),
    "blinded_tracks": (
        lambda s, d: labels.blinded(made_tracks(s, d), tracks.shapes(lens.positions(s, d))).select("mmsi", "voyage", F.col("step").cast("long").alias("step"), "x_km", "y_km", "speed_kn"),
        _with(*oracles._BASE, _SHAPES) + """SELECT m.mmsi, m.voyage, spot + 1 AS step, round(sum(dx) OVER w, 5) + 0.0 AS x_km, round(sum(dy) OVER w, 5) + 0.0 AS y_km, round(CASE WHEN t.end_us > t.start_us THEN sqrt(dx * dx + dy * dy) / 1.852 / ((t.end_us - t.start_us) / 3.6e9 / 15) ELSE 0.0 END, 2) AS speed_kn
          FROM moves m JOIN tracks t ON t.mmsi = m.mmsi AND t.voyage = m.voyage WHERE spot >= 0 WINDOW w AS (PARTITION BY m.mmsi, m.voyage ORDER BY spot)""",
    ),
    # figures
    "data_snapshot": (
        lambda s, d: figures.data_snapshot(lens.positions(s, d), made_tracks(s, d), deterministic(s, d), inputs.spans(s)),
        _with(*_ALL_O) + "SELECT count(*) AS positions, count(DISTINCT mmsi) AS vessels, min(us) AS min_us, max(us) AS max_us, (SELECT count(*) FROM tracks) AS tracks, (SELECT count(*) FROM found) AS incidents, (SELECT round(sum(end_us - start_us) / 3.6e9, 6) FROM observed) AS observed_hours FROM positions",
    ),
    "recent_counts": (lambda s, d: figures.recent_counts(deterministic(s, d), NOW), _with(*_ALL) + f"SELECT detector, count(*) AS n FROM found WHERE ts_start_us >= {NOW} - 86400000000 GROUP BY 1"),
    "score_levels": (
        lambda s, d: figures.score_levels(deterministic(s, d), NOW, 20),
        _with(*_ALL) + ", ".join(["SELECT " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {n}_{k}" for n, c in (("all", "score"), ("recent", f"CASE WHEN ts_start_us >= {NOW} - 72000000000 THEN score END")) for k, q in (("p50", 0.5), ("p95", 0.95)))]) + " FROM found",
    ),
    "verdict_counts": (
        _verdicts,
        _with(oracles.STEPS, oracles.SILENT, oracles.COVERED) + f""", g AS (SELECT verdict, {oracles._cut('round(least(1.0, base + bonus), 4)', oracles._GRADES, 'F')} AS before, {oracles._cut('round(least(1.0, least(1.0, base * factor) + bonus), 4)', oracles._GRADES, 'F')} AS after FROM (SELECT verdict, CASE verdict WHEN 'vessel-attributed' THEN 1.6 WHEN 'partial' THEN 1.0 ELSE 0.5 END AS factor,
            0.35 + CASE WHEN sens THEN 0.15 ELSE 0.0 END AS base, CASE WHEN sens THEN 0.1 ELSE 0.0 END AS bonus FROM (SELECT *, {oracles._sensitive(oracles._zone('prev_lat', 'prev_lon'))} AS sens FROM verdicts)))
          SELECT verdict, count(*) AS n, """ + ", ".join(f"count(*) FILTER (WHERE {c} = '{x}') AS {c}_{x.lower()}" for c in ("before", "after") for x in "BCDEF") + " FROM g GROUP BY verdict",
    ),
    # books and upkeep
    "feed_outages": (
        lambda s, d: collector.outages(lens.positions(s, d).select(F.col("region").alias("key"), "us"), 60),
        _with() + "SELECT key, before + 60000000 AS opened_us, us AS closed_us FROM (SELECT key, us, lag(us) OVER (PARTITION BY key ORDER BY us) AS before FROM (SELECT DISTINCT region AS key, us FROM positions)) WHERE us - before > 60000000",
    ),
    "batch_counts": (lambda s, d: ledger.batch_counts(lens.positions(s, d).where(F.col("us") < CUT)), _with() + f"SELECT count(*) AS reports, count(DISTINCT mmsi) AS vessels, max(us) AS last_message_us FROM positions WHERE us < {CUT}"),
    "batch_flush": (
        _flushed,
        _with(lens.VESSELS_SQL) + f""", new_ AS (SELECT DISTINCT mmsi, us // 7200000000 AS us FROM positions WHERE id % 4 <> 0), kept AS (SELECT mmsi, count(*) AS n FROM new_ WHERE (mmsi, us) NOT IN (SELECT (mmsi, us // 7200000000) FROM positions WHERE id % 4 = 0) GROUP BY 1), early AS (SELECT mmsi, min(us) AS a, max(us) AS b FROM positions WHERE us < {CUT} GROUP BY 1), late AS (SELECT mmsi, min(us) AS a, max(us) AS b FROM positions WHERE us >= {CUT} GROUP BY 1)
          SELECT coalesce(e.mmsi, l.mmsi) AS mmsi, CASE WHEN l.mmsi IS NOT NULL THEN v.name END AS name, least(e.a, l.a) AS first_us, greatest(e.b, l.b) AS last_us, CASE WHEN k.n IS NULL THEN 0 ELSE 1 END AS dirty, coalesce(k.n, 0) AS reports FROM early e FULL JOIN late l ON l.mmsi = e.mmsi JOIN vessels v ON v.mmsi = coalesce(e.mmsi, l.mmsi) LEFT JOIN kept k ON k.mmsi = v.mmsi""",
    ),
    "region_rebuild": (_rebuilt, _with(*oracles._BASE) + "SELECT track_id, mmsi, 'singapore' AS region, point_count FROM tracks UNION ALL SELECT 'old-' || track_id, mmsi, 'elsewhere', 0 FROM tracks"),
    "detector_rebuild": (_found_again, _with(*_ALL) + "SELECT incident_id, mmsi, 'singapore' AS region, detector, CASE WHEN detector IN ('gap', 'spoof') THEN score ELSE 0.0 END AS score FROM found"),
    "incremental_incidents": (
        lambda s, d: (lambda p: incremental.refreshed_incidents(p, detect.all_incidents(p.where(F.col("us") < CUT), inputs.outages(s)), upkeep.dirty_backlog(p, tracks.summaries(p.where(F.col("us") < CUT))), inputs.outages(s)))(lens.positions(s, d)).select("incident_id", "mmsi", "detector", "score", "ts_start_us", "ts_end_us"),
        _with(*_ALL) + "SELECT incident_id, mmsi, detector, score, ts_start_us, ts_end_us FROM found",
    ),
    "downsample_default": (lambda s, d: downsample.downsampled(lens.positions(s, d)).select("id", "mmsi"), _DOWN),
    "retention_default": (lambda s, d: upkeep.pruned(lens.positions(s, d), lens.EPOCH_US + 22 * DAY).select("id"), _with() + f"SELECT id FROM positions WHERE us >= {lens.EPOCH_US + DAY}"),
    # sources
    "csv_reports": (
        _csv,
        _with() + f"""SELECT mmsi, count(*) AS n, min(us // 1000000 * 1000000) AS first_us, round(sum(sog), 4) AS knots, 'tug' AS status FROM positions WHERE id % 11 <> 0 AND id % 7 <> 0 AND lat BETWEEN {BOX[0]} AND {BOX[2]} AND lon BETWEEN {BOX[1]} AND {BOX[3]} GROUP BY mmsi""",
    ),
    "live_reports": (_messages, _with() + "SELECT mmsi, count(*) AS n, count(CASE WHEN id % 17 <> 0 THEN sog END) AS n_sog, CAST(0 AS BIGINT) AS n_cog, round(sum(CASE WHEN id % 17 <> 0 THEN sog END), 4) AS knots, max(us // 1000000 * 1000000) AS last_us FROM positions WHERE id % 13 <> 0 AND id % 19 <> 0 GROUP BY mmsi"),
    "parsed_fields": (
        _parsed,
        _with() + f"""SELECT id, c::DOUBLE AS number, CASE WHEN id % 100 % 8 <> 0 THEN 'n' || id % 100 END AS word, CASE WHEN c IS NULL THEN NULL WHEN c = 30 THEN 'fishing' WHEN c BETWEEN 31 AND 39 THEN 'special' WHEN c BETWEEN 60 AND 69 THEN 'passenger' WHEN c BETWEEN 70 AND 79 THEN 'cargo' WHEN c BETWEEN 80 AND 89 THEN 'tanker' WHEN c = 52 THEN 'tug' ELSE 'other' END AS ship_type, 'SG' AS flag,
          CASE WHEN heading < 300 THEN heading END AS heading, abs((heading - 350 + 180 + 720) % 360 - 180) AS turn, ['source-connectivity', 'local-storage', 'collector-offline', 'source-connectivity', 'coverage-unavailable'][id % 5 + 1] AS category, round(least(1.0, greatest(0.0, 0.5 * sog / (4.0 + 1e-12))), 9) AS score
          FROM (SELECT *, CASE WHEN id % 100 % 9 <> 0 THEN id % 100 END AS c FROM positions)""",
    ),
    "zones_containing": (lambda s, d: lens.positions(s, d).select("id", F.array_join(zones.zones_of(F.col("lat"), F.col("lon")), ",").alias("zones")), _with() + "SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN {oracles._inside(z[3], 'lat', 'lon')} THEN '{z[0]}' END" for z in zones.ZONES) + ") AS zones FROM positions"),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in TABLE.items()}
