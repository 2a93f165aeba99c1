"""DuckDB SQL for the registered queries, put together from shared common table expressions."""

from __future__ import annotations

from tidewatch.functions import zones
from tidewatch.plans.fixtures import EVENTS, OUTAGES, RUNS
from tidewatch.plans.inputs import NOW
from tidewatch.sources import lens


def _km(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371.0088 * asin(sqrt(least(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2), 1.0))))"


def _inside(ring: list[tuple[float, float]], lat: str, lon: str) -> str:
    tests = [f"CAST((({a} > {lat}) <> ({c} > {lat})) AND ({lon} < CAST({d - b!r} AS DOUBLE) * ({lat} - {a}) / CAST({c - a!r} AS DOUBLE) + {b}) AS INTEGER)" for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True) if a != c]
    return f"(({' + '.join(tests)}) % 2 = 1)"


def _zone(lat: str, lon: str) -> str:
    return "CASE " + " ".join(f"WHEN {_inside(zones.ZONES[k][3], lat, lon)} THEN '{zones.ZONES[k][0]}'" for k in zones.PRIORITY) + " END"


def _port(lat: str, lon: str) -> str:
    return " OR ".join(_inside(z[3], lat, lon) for z in zones.ZONES if z[1] == "port")


def _sensitive(zone: str) -> str:
    return f"coalesce({zone} IN ({', '.join(repr(z[0]) for z in zones.ZONES if z[2])}), false)"


def _cut(x: str, cuts: list[tuple[float, str]], rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {v} THEN '{n}'" for v, n in cuts) + f" ELSE '{rest}' END"


_GRADES = [(0.8, "B"), (0.6, "C"), (0.4, "D"), (0.2, "E")]
_SEVERITIES = [(0.85, "critical"), (0.65, "high"), (0.4, "moderate")]

_values = lambda rows: ", ".join("(" + ", ".join("NULL" if x is None else repr(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)

STEPS = f"""lagged AS (SELECT *, lag(us) OVER w AS prev_us, lag(lat) OVER w AS prev_lat, lag(lon) OVER w AS prev_lon FROM positions WINDOW w AS (PARTITION BY mmsi ORDER BY us, id)),
metred AS (SELECT *, (us - prev_us) / 1e6 AS seconds, {_km('prev_lat', 'prev_lon', 'lat', 'lon')} AS km FROM lagged),
steps AS (SELECT *, CASE WHEN prev_us IS NULL THEN NULL WHEN seconds <= 0 THEN 0.0 ELSE km / 1.852 / (seconds / 3600.0) END AS knots FROM metred)"""
VOYAGES = """voyages AS (SELECT *, CAST(sum(CASE WHEN seconds > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY us, id) AS BIGINT) AS voyage,
  prev_us IS NOT NULL AND seconds <= 3600 AS inner_ FROM steps)"""
TRACKS = """tracks AS (SELECT mmsi, voyage, min(us) AS start_us, max(us) AS end_us, count(*) AS point_count, sum(CASE WHEN inner_ THEN km ELSE 0.0 END) AS distance_km, max(CASE WHEN inner_ THEN knots ELSE 0.0 END) AS max_implied_kn,
  arg_min(lat, (us, id)) AS start_lat, arg_min(lon, (us, id)) AS start_lon, arg_max(lat, (us, id)) AS end_lat, arg_max(lon, (us, id)) AS end_lon, avg(sog) AS mean_sog,
  mmsi || ':' || strftime(make_timestamp(min(us)), '%Y-%m-%dT%H:%M:%S.%f') AS track_id FROM voyages GROUP BY mmsi, voyage)"""
SILENT = f"""outages(opened_us, closed_us) AS (VALUES {_values([(o[1], o[2]) for o in OUTAGES])}),
silent AS (SELECT * FROM steps WHERE seconds >= 7200 AND km >= 5 AND NOT EXISTS (SELECT 1 FROM outages o WHERE o.opened_us < steps.us AND (o.closed_us IS NULL OR o.closed_us > steps.prev_us)))"""
COVERED = """witness AS (SELECT DISTINCT CAST(floor(lat / 0.25) AS BIGINT) AS cy, CAST(floor(lon / 0.25) AS BIGINT) AS cx, us // 3600000000 AS hour, mmsi FROM positions),
corridor AS (SELECT id, mmsi AS own, i AS sample, CAST(floor((prev_lat + (lat - prev_lat) * (i / 11.0::DOUBLE)) / 0.25) AS BIGINT) AS cy, CAST(floor((prev_lon + (lon - prev_lon) * (i / 11.0::DOUBLE)) / 0.25) AS BIGINT) AS cx,
               unnest(range(prev_us // 3600000000, us // 3600000000 + 1)) AS hour FROM silent, range(12) r(i)),
heard AS (SELECT DISTINCT c.id, c.sample, w.mmsi FROM corridor c JOIN witness w ON w.cy = c.cy AND w.cx = c.cx AND w.hour = c.hour AND w.mmsi <> c.own),
points AS (SELECT id, sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) AS witnessed, sum(CASE WHEN n >= 2 AND sample IN (0, 11) THEN 1 ELSE 0 END) AS ends FROM (SELECT id, sample, count(*) AS n FROM heard GROUP BY id, sample) GROUP BY id),
others AS (SELECT id, count(DISTINCT mmsi) AS witnesses FROM heard GROUP BY id),
covered AS (SELECT s.*, CAST(coalesce(witnessed, 0) AS BIGINT) AS witnessed, CAST(coalesce(witnesses, 0) AS BIGINT) AS witnesses, CAST(coalesce(ends, 0) AS BIGINT) AS ends, coalesce(witnessed, 0) / 12.0::DOUBLE AS support FROM silent s LEFT JOIN points USING (id) LEFT JOIN others USING (id)),
verdicts AS (SELECT *, CASE WHEN support >= 0.75 THEN 'vessel-attributed' WHEN support >= 0.25 THEN 'partial' ELSE 'coverage-explained' END AS verdict FROM covered)"""
_NO = "NULL::DOUBLE"
DWELLS = f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY us, id) AS rn, count(*) OVER (PARTITION BY mmsi) AS n FROM positions),
reach AS (SELECT a.mmsi, a.rn AS i, coalesce(min(b.rn) FILTER (WHERE {_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} > 2), a.n + 1) AS j, a.us AS from_us FROM ordered a LEFT JOIN ordered b ON b.mmsi = a.mmsi AND b.rn > a.rn GROUP BY a.mmsi, a.rn, a.n, a.us),
dwells AS (SELECT r.mmsi, r.i, r.j, r.from_us, max(o.us) AS to_us, count(*) AS points, round(avg(o.lat), 11) AS lat, round(avg(o.lon), 11) AS lon, round(coalesce(avg(o.sog), 0.0), 9) AS mean FROM reach r JOIN ordered o ON o.mmsi = r.mmsi AND o.rn >= r.i AND o.rn < r.j GROUP BY r.mmsi, r.i, r.j, r.from_us),
walk AS (SELECT mmsi, i, j, points >= 2 AND to_us - from_us >= 3600000000 AND mean BETWEEN 0.5 AND 2.0 AS hit FROM dwells WHERE i = 1
  UNION ALL SELECT d.mmsi, d.i, d.j, d.points >= 2 AND d.to_us - d.from_us >= 3600000000 AND d.mean BETWEEN 0.5 AND 2.0 FROM walk w JOIN dwells d ON d.mmsi = w.mmsi AND d.i = CASE WHEN w.hit THEN w.j ELSE w.i + 1 END),
loiter_raw AS (SELECT 'loiter' AS detector, mmsi, NULL::VARCHAR AS other, least(1.0, 0.4 + 0.3 * least(1.0, m / 180) + extra) AS score, 0.5 + extra AS confidence, from_us AS ts_start_us, to_us AS ts_end_us, lat, lon,
    round(m, 1) AS minutes, 2.0::DOUBLE AS km, round(mean, 2) AS knots, CASE WHEN z IS NULL THEN 'loitering' ELSE 'zone incursion / loitering' END AS incident_type, CASE WHEN z IS NULL THEN 'loitering' ELSE 'loitering,zone-incursion' END AS techniques, points
  FROM (SELECT d.*, (to_us - from_us) / 60e6 AS m, {_zone('lat', 'lon')} AS z, CASE WHEN {_sensitive(_zone('lat', 'lon'))} THEN 0.2::DOUBLE ELSE 0.0 END AS extra FROM dwells d JOIN walk w ON w.mmsi = d.mmsi AND w.i = d.i WHERE w.hit) WHERE NOT ({_port('lat', 'lon')}))"""
_LEG_AT = lambda c, leg: f"({leg}.prev_{c} + ({leg}.{c} - {leg}.prev_{c}) * ((g.t - {leg}.prev_us) / ({leg}.us - {leg}.prev_us)))"
_SHORT = "CASE WHEN lon - prev_lon > 180 THEN lon - prev_lon - 360 WHEN lon - prev_lon < -180 THEN lon - prev_lon + 360 ELSE lon - prev_lon END"
MEETINGS = f"""paced AS (SELECT mmsi, id, us, lat, lon, coalesce(sog, 0.0) AS v, coalesce(lag(us) OVER w, us - 1) AS prev_us, coalesce(lag(lat) OVER w, lat) AS prev_lat, coalesce(lag(lon) OVER w, lon) AS prev_lon, coalesce(lag(coalesce(sog, 0.0)) OVER w, coalesce(sog, 0.0)) AS prev_v
  FROM positions WINDOW w AS (PARTITION BY mmsi ORDER BY us, id)),
legs AS (SELECT * REPLACE (prev_lon + {_SHORT} AS lon) FROM paced WHERE us > prev_us),
moving AS (SELECT mmsi, min(us) AS first_us, max(us) AS last_us FROM positions GROUP BY mmsi HAVING max(coalesce(sog, 0.0)) >= 3 AND count(*) >= 2),
couples AS (SELECT a.mmsi AS a, b.mmsi AS b, greatest(a.first_us, b.first_us) AS t0, least(a.last_us, b.last_us) AS t1 FROM moving a JOIN moving b ON a.mmsi < b.mmsi WHERE least(a.last_us, b.last_us) - greatest(a.first_us, b.first_us) >= 1800000000),
halts AS (SELECT * FROM legs WHERE least(v, prev_v) <= 1),
grid AS (SELECT a, b, k, t0 + k * 300000000 AS t, us, lat, lon, v, prev_us, prev_lat, prev_lon, prev_v FROM (SELECT c.a, c.b, c.t0, h.*, unnest(range(CASE WHEN prev_us < t0 THEN 0 ELSE (prev_us - t0) // 300000000 + 1 END, CASE WHEN least(us, t1) < t0 THEN 0 ELSE (least(us, t1) - t0) // 300000000 + 1 END)) AS k FROM couples c JOIN halts h ON h.mmsi = c.a)),
slow_a AS (SELECT a, b, k, t, {_LEG_AT('lat', 'g')} AS a_lat, {_LEG_AT('lon', 'g')} AS a_lon FROM grid g WHERE {_LEG_AT('v', 'g')} <= 1),
slow_b AS (SELECT g.*, {_LEG_AT('lat', 'l')} AS b_lat, {_LEG_AT('lon', 'l')} AS b_lon FROM slow_a g ASOF JOIN legs l ON l.mmsi = g.b AND g.t <= l.us WHERE g.t > l.prev_us AND {_LEG_AT('v', 'l')} <= 1),
moments AS (SELECT * FROM (SELECT a, b, k, t, a_lat, a_lon, {_km('a_lat', 'a_lon', 'b_lat', 'b_lon')} AS km FROM slow_b) WHERE km <= 0.5),
stays AS (SELECT a, b, count(*) AS n, min(t) AS t0, max(t) AS t1, avg(a_lat) AS lat, avg(a_lon) AS lon, min(km) AS km FROM (SELECT *, k - row_number() OVER (PARTITION BY a, b ORDER BY k) AS island FROM moments) GROUP BY a, b, island),
longest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, t0) AS place FROM stays) WHERE place = 1 AND (n - 1) * 5 >= 30 AND NOT ({_port('lat', 'lon')})),
degrees_ AS (SELECT mmsi, count(*) AS degree FROM (SELECT a AS mmsi FROM longest UNION ALL SELECT b FROM longest) GROUP BY mmsi),
met AS (SELECT l.* FROM longest l JOIN degrees_ x ON x.mmsi = a JOIN degrees_ y ON y.mmsi = b WHERE x.degree <= 2 AND y.degree <= 2),
rendezvous_raw AS (SELECT 'rendezvous' AS detector, mmsi, other, 0.55 + 0.35 * least(1.0, (n - 1) * 5.0::DOUBLE / 90) AS score, 0.6::DOUBLE AS confidence, t0 AS ts_start_us, t1 AS ts_end_us, lat, lon, round((n - 1) * 5.0::DOUBLE, 1) AS minutes, round(km, 3) AS km, NULL::DOUBLE AS knots,
    'ship-to-ship transfer' AS incident_type, 'sts-transfer,rendezvous' AS techniques FROM (SELECT a AS mmsi, b AS other, * FROM met UNION ALL SELECT b, a, * FROM met))"""
_RAW2 = f"""gap_raw AS (SELECT 'gap' AS detector, mmsi, 0.4 + 0.3 * least(1.0, seconds / 60 / 360) + 0.3 * least(1.0, km / 25) AS score,
    least(1.0, (0.35 + CASE WHEN {_sensitive(_zone('prev_lat', 'prev_lon'))} THEN 0.15 ELSE 0.0 END) * CASE verdict WHEN 'vessel-attributed' THEN 1.6 WHEN 'partial' THEN 1.0 ELSE 0.5 END) AS confidence,
    prev_us AS ts_start_us, us AS ts_end_us, prev_lat AS lat, prev_lon AS lon, round(seconds / 60, 1) AS minutes, round(km, 2) AS km, round(knots, 1) AS knots, 'dark ship (AIS gap)' AS incident_type, 'ais-gap,going-dark' AS techniques, verdict, support, witnessed, witnesses, ends FROM verdicts),
spoof_raw AS (SELECT 'spoof' AS detector, mmsi, least(1.0, 0.7 + knots / 1200) AS score, 0.85 AS confidence, us AS ts_start_us, us AS ts_end_us, lat, lon, round(seconds / 60, 1) AS minutes, round(km, 1) AS km, round(knots, 1) AS knots,
    CASE WHEN seconds < 60 THEN 'duplicate identity' ELSE 'impossible kinematics' END AS incident_type, 'ais-spoof,impossible-kinematics' AS techniques, round(seconds, 1) AS interval_s FROM steps WHERE knots > 60)"""
_JUDGED = f"""zoned AS (SELECT *, {_zone('lat', 'lon')} AS zone_id FROM raw_),
graded AS (SELECT * REPLACE (round(score, 4) AS score, round(least(1.0, confidence + CASE WHEN {_sensitive('zone_id')} THEN 0.1 ELSE 0.0 END), 4) AS confidence) FROM zoned),
every_found AS (SELECT *, concat_ws('-', detector, mmsi, other, CAST(ts_start_us // 1000000 AS VARCHAR)) AS incident_id, {_cut('score', _SEVERITIES, 'low')} AS severity, {_cut('confidence', _GRADES, 'F')} AS reliability FROM graded)"""
FOUND2 = _RAW2 + f""", raw_ AS (SELECT * FROM gap_raw UNION ALL BY NAME SELECT * FROM spoof_raw UNION ALL BY NAME SELECT NULL::VARCHAR AS other WHERE false), {_JUDGED}, found AS (SELECT * FROM every_found)"""
FOUND = _RAW2 + ",\n" + DWELLS + ",\n" + MEETINGS + f""", raw_ AS (SELECT *, 0 AS ord FROM gap_raw UNION ALL BY NAME SELECT *, 1 AS ord FROM rendezvous_raw UNION ALL BY NAME SELECT *, 2 AS ord FROM loiter_raw UNION ALL BY NAME SELECT *, 3 AS ord FROM spoof_raw),
{_JUDGED}, found AS (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY ord, ts_end_us, lat, lon) AS place FROM every_found) WHERE place = 1)"""
SHOWN = "incident_id, mmsi, detector, incident_type, score, severity, reliability, confidence, ts_start_us, ts_end_us, round(lat, 9) AS lat, round(lon, 9) AS lon, zone_id, techniques, minutes, km, knots"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([lens.SQL.strip(), *parts]) + "\n"


_BASE = (STEPS, VOYAGES, TRACKS)
_TWO = (STEPS, SILENT, COVERED, FOUND2)
_INCIDENTS = (STEPS, SILENT, COVERED, FOUND)
_EVENTS = f"ext(event_id, kind, mmsi, ts_us, lat, lon) AS (VALUES {_values(EVENTS)})"
_MERGE = lambda src, out: f"{out}_m AS (SELECT *, max(end_us) OVER (PARTITION BY key ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}), {out}_i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_us > reach THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY start_us, end_us) AS island FROM {out}_m), {out} AS (SELECT key, min(start_us) AS start_us, max(end_us) AS end_us FROM {out}_i GROUP BY key, island)"
_NOW = NOW
_OBSERVED = f"""runs(key, started_us, stopped_us, last_message_us) AS (VALUES {_values(RUNS)}), outs(key, opened_us, closed_us) AS (VALUES {_values(OUTAGES)}),
run_spans AS (SELECT key, started_us AS start_us, least(coalesce(stopped_us, last_message_us), {_NOW}) AS end_us FROM runs WHERE coalesce(stopped_us, last_message_us) IS NOT NULL),
out_spans AS (SELECT key, opened_us AS start_us, least(coalesce(closed_us, {_NOW}), {_NOW}) AS end_us FROM outs), {_MERGE('run_spans', 'rm')}, {_MERGE('out_spans', 'om')},
marks AS (SELECT DISTINCT key, mark FROM (SELECT key, start_us AS mark FROM rm UNION ALL SELECT key, end_us FROM rm UNION ALL SELECT key, start_us FROM om UNION ALL SELECT key, end_us FROM om)),
bits AS (SELECT key, mark AS start_us, lead(mark) OVER (PARTITION BY key ORDER BY mark) AS end_us FROM marks),
kept AS (SELECT b.key, b.start_us, b.end_us FROM bits b WHERE b.end_us IS NOT NULL AND EXISTS (SELECT 1 FROM rm WHERE rm.key = b.key AND rm.start_us <= b.start_us AND rm.end_us >= b.end_us) AND NOT EXISTS (SELECT 1 FROM om WHERE om.key = b.key AND om.start_us <= b.start_us AND om.end_us >= b.end_us)),
{_MERGE('kept', 'observed')}"""

ORACLES = {
    "position_reports": _with() + "SELECT id, mmsi, us, round(lat, 9) AS lat, round(lon, 9) AS lon, round(sog, 6) AS sog FROM positions",
    "haversine_steps": _with(STEPS) + "SELECT id, mmsi, us, seconds, round(km, 6) AS km, round(knots, 4) AS knots FROM steps WHERE prev_us IS NOT NULL",
    "voyage_segments": _with(STEPS, VOYAGES) + "SELECT id, mmsi, us, voyage FROM voyages",
    "track_summary": _with(*_BASE) + "SELECT track_id, mmsi, voyage, start_us, end_us, point_count, round(distance_km, 6) AS distance_km, round(max_implied_kn, 4) AS max_implied_kn, round(start_lat, 9) AS start_lat, round(end_lon, 9) AS end_lon, round(mean_sog, 6) AS mean_sog FROM tracks",
    "gap_coverage": _with(STEPS, SILENT, COVERED) + "SELECT id, mmsi, witnessed, witnesses, round(support, 6) AS support, verdict FROM verdicts",
    "gap_incidents": _with(*_TWO) + f"SELECT {SHOWN} FROM found WHERE detector = 'gap'",
    "spoof_incidents": _with(*_TWO) + f"SELECT {SHOWN} FROM found WHERE detector = 'spoof'",
    "loiter_incidents": _with(DWELLS, "raw_ AS (SELECT * FROM loiter_raw)", _JUDGED) + f"SELECT {SHOWN} FROM every_found",
    "rendezvous_incidents": _with(MEETINGS, "raw_ AS (SELECT * FROM rendezvous_raw)", _JUDGED) + f"SELECT {SHOWN} FROM every_found",
    "near_moments": _with(MEETINGS) + "SELECT a, b, k, t AS us, round(a_lat, 9) AS lat, round(a_lon, 9) AS lon, round(km, 9) AS km FROM moments",
    "partner_degree": _with(MEETINGS) + "SELECT mmsi, count(*) AS degree FROM (SELECT a AS mmsi FROM met UNION ALL SELECT b FROM met) GROUP BY mmsi",
    "zone_attribution": _with() + f"SELECT id, {_zone('lat', 'lon')} AS zone_id, {' OR '.join(_inside(z[3], 'lat', 'lon') for z in zones.ZONES if z[1] == 'port')} AS in_port FROM positions",
    "witness_index": _with() + "SELECT DISTINCT CAST(floor(lat / 0.25) AS BIGINT) AS cell_lat, CAST(floor(lon / 0.25) AS BIGINT) AS cell_lon, us // 3600000000 AS hour, mmsi FROM positions",
    "footprint_profile": _with() + "SELECT b * 0.5::DOUBLE AS lat_from, count(DISTINCT mmsi) AS vessels, count(DISTINCT c) AS cells FROM (SELECT CAST(floor(lat / 0.5) AS BIGINT) AS b, mmsi, (floor(lat / 0.25), floor(lon / 0.25)) AS c FROM positions) GROUP BY b",
    "observed_vessel_hours": _with(*_BASE, _OBSERVED) + "SELECT t.mmsi, track_id, round(sum(greatest(0, least(t.end_us, o.end_us) - greatest(t.start_us, o.start_us))) / 3.6e9, 6) AS observed_hours FROM tracks t JOIN observed o ON t.start_us < o.end_us AND t.end_us > o.start_us GROUP BY t.mmsi, track_id",
    "incident_track_attribution": _with(STEPS, VOYAGES, TRACKS, SILENT, COVERED, FOUND) + """SELECT incident_id, track_id, overlap_us FROM (SELECT incident_id, track_id, least(end_us, ts_end_us) - greatest(start_us, ts_start_us) AS overlap_us,
        row_number() OVER (PARTITION BY incident_id ORDER BY least(end_us, ts_end_us) - greatest(start_us, ts_start_us) DESC, track_id DESC) AS k
        FROM found JOIN tracks ON tracks.mmsi = found.mmsi AND start_us <= ts_end_us AND end_us >= ts_start_us) WHERE k = 1""",
    "event_track_match": _with(*_BASE, _EVENTS) + f"""SELECT event_id, track_id, rank_value, status FROM (
        SELECT *, CASE WHEN second <= 2.0 * greatest(first, 1e-9) THEN 'ambiguous' ELSE 'matched' END AS status FROM (
          SELECT event_id, track_id, rank_value, row_number() OVER o AS k, first_value(rank_value) OVER f AS first, nth_value(rank_value, 2) OVER f AS second FROM (
            SELECT *, bool_or(named) OVER (PARTITION BY event_id) AS any_named FROM (
              SELECT e.event_id, t.track_id, coalesce(e.mmsi = t.mmsi, false) AS named,
                     greatest(0, t.start_us - e.ts_us, e.ts_us - t.end_us) AS away_us, least({_km('e.lat', 'e.lon', 't.start_lat', 't.start_lon')}, {_km('e.lat', 'e.lon', 't.end_lat', 't.end_lon')}) AS km,
                     round(greatest(0, t.start_us - e.ts_us, e.ts_us - t.end_us) / 86400000000.0::DOUBLE + coalesce(least({_km('e.lat', 'e.lon', 't.start_lat', 't.start_lon')}, {_km('e.lat', 'e.lon', 't.end_lat', 't.end_lon')}) / 25, 0.0), 6) AS rank_value
              FROM ext e JOIN tracks t ON true) WHERE away_us <= 86400000000 AND (named OR km <= 25)) WHERE named OR NOT any_named
          WINDOW o AS (PARTITION BY event_id ORDER BY rank_value, track_id), f AS (PARTITION BY event_id ORDER BY rank_value, track_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) WHERE status = 'ambiguous' OR k = 1
        UNION ALL SELECT event_id, NULL, NULL, 'unmatched' FROM ext e WHERE NOT EXISTS (SELECT 1 FROM tracks t WHERE greatest(0, t.start_us - e.ts_us, e.ts_us - t.end_us) <= 86400000000
          AND (coalesce(e.mmsi = t.mmsi, false) OR least({_km('e.lat', 'e.lon', 't.start_lat', 't.start_lon')}, {_km('e.lat', 'e.lon', 't.end_lat', 't.end_lon')}) <= 25))""",
    "corroborated_incidents": _with(*_INCIDENTS, _EVENTS) + f"SELECT incident_id FROM found f WHERE EXISTS (SELECT 1 FROM ext e WHERE e.kind = f.detector AND (e.mmsi IS NULL OR e.mmsi = f.mmsi) AND greatest(0, f.ts_start_us - e.ts_us, e.ts_us - f.ts_end_us) <= 86400000000 AND {_km('f.lat', 'f.lon', 'e.lat', 'e.lon')} <= 25)",
    "position_dedup": _with() + "SELECT id, mmsi, us FROM (SELECT id, mmsi, us // 7200000000 AS us, row_number() OVER (PARTITION BY mmsi, us // 7200000000 ORDER BY id DESC) AS k FROM positions WHERE id % 4 <> 0) b WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM positions s WHERE s.id % 4 = 0 AND s.mmsi = b.mmsi AND s.us // 7200000000 = b.us)",
    "vessel_dimension": _with() + "SELECT mmsi, min(us) AS first_us, max(us) AS last_us, arg_min(nav_status, (us, id)) AS first_status, count(*) AS reports FROM positions GROUP BY mmsi",
    "dirty_backlog": _with(*_BASE) + "SELECT p.mmsi, last_us, built_us FROM (SELECT mmsi, max(us) AS last_us FROM positions GROUP BY mmsi) p LEFT JOIN (SELECT mmsi, max(end_us) AS built_us FROM tracks WHERE voyage < 6 GROUP BY mmsi) t ON t.mmsi = p.mmsi WHERE built_us IS NULL OR last_us > built_us",
    "incremental_tracks": _with(*_BASE) + "SELECT track_id, mmsi, voyage, start_us, end_us, point_count FROM tracks",
    "pilot_figures": _with(STEPS, VOYAGES, TRACKS, SILENT.replace("outages(", "outages_(").replace("FROM outages o", "FROM outages_ o"), COVERED, FOUND, _OBSERVED) + f""", vh AS (SELECT round(sum(h), 4) AS vessel_hours FROM (SELECT round(sum(greatest(0, least(t.end_us, o.end_us) - greatest(t.start_us, o.start_us))) / 3.6e9, 6) AS h FROM tracks t JOIN observed o ON t.start_us < o.end_us AND t.end_us > o.start_us GROUP BY t.track_id))
        SELECT (SELECT round(sum(greatest(0, least(coalesce(closed_us, {_NOW}), {_NOW}) - opened_us)) / 3.6e9, 6) FROM outs) AS outage_hours, (SELECT count(*) - 1 FROM runs) AS reconnects,
               (SELECT round(sum(end_us - start_us) / ({_NOW} - (SELECT min(started_us) FROM runs)), 6) FROM observed) AS uptime, vessel_hours, (SELECT count(*) FROM found) AS alerts, round(100 * (SELECT count(*) FROM found) / vessel_hours, 4) AS alerts_per_100_hours FROM vh""",
    "external_agreement": _with(*_INCIDENTS, _EVENTS) + f"SELECT detector, count(*) AS n, count(*) FILTER (WHERE hit) AS k, round(count(*) FILTER (WHERE hit) / count(*), 6) AS rate FROM (SELECT detector, EXISTS (SELECT 1 FROM ext e WHERE e.kind = f.detector AND (e.mmsi IS NULL OR e.mmsi = f.mmsi) AND greatest(0, f.ts_start_us - e.ts_us, e.ts_us - f.ts_end_us) <= 86400000000 AND {_km('f.lat', 'f.lon', 'e.lat', 'e.lon')} <= 25) AS hit FROM found f) GROUP BY 1",
    "retention": _with() + "SELECT id FROM positions WHERE us >= 1704067200000000 + 43200000000",
    "downsample_positions": _with("ordered AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY us, id) AS rn FROM positions)", """walk AS (
        SELECT mmsi, rn, id, us AS l_us, heading AS l_h, sog AS l_s, nav_status AS l_n, true AS ok FROM ordered WHERE rn = 1
        UNION ALL SELECT o.mmsi, o.rn, o.id, CASE WHEN hit THEN o.us ELSE l_us END, CASE WHEN hit THEN o.heading ELSE l_h END, CASE WHEN hit THEN o.sog ELSE l_s END, CASE WHEN hit THEN o.nav_status ELSE l_n END, hit
        FROM (SELECT o.*, w.l_us, w.l_h, w.l_s, w.l_n, ((o.us - w.l_us) / 1e6 >= 1800 OR o.nav_status <> w.l_n OR abs(((o.heading - w.l_h + 180 + 360) % 360) - 180) >= 120 OR abs(o.sog - w.l_s) >= 5) AS hit
              FROM walk w JOIN ordered o ON o.mmsi = w.mmsi AND o.rn = w.rn + 1) o)""") + "SELECT id, mmsi FROM walk WHERE ok",
    "vessel_threat_kinematic": _with(*_TWO) + f"""SELECT mmsi, n_incidents, n_detectors, detectors, techniques, max_score, best_reliability, risk, {_cut('risk', [(0.8, 'critical'), (0.6, 'high'), (0.4, 'moderate')], 'low')} AS severity FROM (
        SELECT *, round(least(1.0, max_score * (0.7 + 0.3 * least(1.0, (n_detectors - 1) / 3.0::DOUBLE)) * (0.6 + 0.4 * CASE best_reliability WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.8 WHEN 'C' THEN 0.6 WHEN 'D' THEN 0.4 WHEN 'E' THEN 0.2 ELSE 0.1 END) + 0.1 * sensitive), 4) AS risk FROM (
          SELECT mmsi, count(*) AS n_incidents, count(DISTINCT detector) AS n_detectors, string_agg(DISTINCT detector, ',' ORDER BY detector) AS detectors,
                 array_to_string(list_sort(list_distinct(flatten(list(string_split(techniques, ','))))), ',') AS techniques, max(score) AS max_score, min(reliability) AS best_reliability, max(CASE WHEN {_sensitive('zone_id')} THEN 1 ELSE 0 END) AS sensitive FROM found GROUP BY mmsi))""",
    "vessel_threat_deterministic": _with(*_INCIDENTS) + f"""SELECT mmsi, n_incidents, n_detectors, detectors, techniques, max_score, best_reliability, risk, {_cut('risk', [(0.8, 'critical'), (0.6, 'high'), (0.4, 'moderate')], 'low')} AS severity FROM (
        SELECT *, round(least(1.0, max_score * (0.7 + 0.3 * least(1.0, (n_detectors - 1) / 3.0::DOUBLE)) * (0.6 + 0.4 * CASE best_reliability WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.8 WHEN 'C' THEN 0.6 WHEN 'D' THEN 0.4 WHEN 'E' THEN 0.2 ELSE 0.1 END) + 0.1 * sensitive), 4) AS risk FROM (
          SELECT mmsi, count(*) AS n_incidents, count(DISTINCT detector) AS n_detectors, string_agg(DISTINCT detector, ',' ORDER BY detector) AS detectors,
                 array_to_string(list_sort(list_distinct(flatten(list(string_split(techniques, ','))))), ',') AS techniques, max(score) AS max_score, min(reliability) AS best_reliability, max(CASE WHEN {_sensitive('zone_id')} THEN 1 ELSE 0 END) AS sensitive FROM found GROUP BY mmsi))""",
    "incident_topk": _with(*_INCIDENTS) + "SELECT incident_id, score FROM found ORDER BY score DESC, incident_id LIMIT 50",
    "public_incidents": _with(*_INCIDENTS) + f"SELECT CAST(sha256(incident_id)[1:12] AS VARCHAR) AS id, detector, severity, reliability, score, floor(lat * 10000 + 0.5) / 10000.0::DOUBLE AS lat, floor(lon * 10000 + 0.5) / 10000.0::DOUBLE AS lon, ts_start_us, zone_id FROM found WHERE ts_end_us <= {_NOW} - 900000000 ORDER BY ts_start_us DESC, score DESC, incident_id LIMIT 200",
    "score_drift": _with(*_INCIDENTS, lens.VESSELS_SQL) + "SELECT ts_start_us // 86400000000 AS day, coalesce(ship_type, 'unknown') AS vessel_type, count(*) AS n, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.95), 6) AS p95 FROM found LEFT JOIN vessels USING (mmsi) GROUP BY 1, 2",
    "detector_pr": _with(*_INCIDENTS, _EVENTS) + """, hits AS (SELECT f.detector, count(DISTINCT event_id) AS found, count(DISTINCT incident_id) AS hits FROM found f JOIN ext e ON e.kind = f.detector AND e.mmsi = f.mmsi AND greatest(ts_start_us, ts_us) <= least(ts_end_us, ts_us) + 1800000000 GROUP BY 1)
        SELECT detector, coalesce(i.n, 0) AS incidents, coalesce(t.n, 0) AS truths, coalesce(found, 0) AS found, coalesce(hits, 0) AS hits, CASE WHEN i.n > 0 THEN round(coalesce(hits, 0) / i.n, 6) ELSE 1.0 END AS "precision", CASE WHEN t.n > 0 THEN round(coalesce(found, 0) / t.n, 6) ELSE 1.0 END AS recall
        FROM (SELECT detector, count(DISTINCT incident_id) AS n FROM found GROUP BY 1) i FULL JOIN (SELECT kind AS detector, count(DISTINCT event_id) AS n FROM ext GROUP BY 1) t USING (detector) LEFT JOIN hits USING (detector)""",
    "wilson_precision": _with(*_INCIDENTS) + """SELECT detector, n, CAST(k AS BIGINT) AS k, round(k / n, 6) AS "precision", round(greatest(0.0, (k / n + zz / (2 * n) - z * sqrt((k / n) * (1 - k / n) / n + zz / (4 * n * n))) / (1 + zz / n)), 6) AS low,
        round(least(1.0, (k / n + zz / (2 * n) + z * sqrt((k / n) * (1 - k / n) / n + zz / (4 * n * n))) / (1 + zz / n)), 6) AS high, k >= 5 AS estimable
        FROM (SELECT detector, count(*) AS n, sum(CASE WHEN ts_start_us // 1000000 % 3 = 0 THEN 1 ELSE 0 END) AS k, 1.959963984540054::DOUBLE AS z, 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE AS zz FROM found GROUP BY 1)""",
    "roc_auc": _with(*_INCIDENTS) + """, s AS (SELECT score, sum(CASE WHEN detector = 'spoof' THEN w ELSE 0.0 END) AS p, sum(CASE WHEN detector <> 'spoof' THEN w ELSE 0.0 END) AS n FROM (SELECT score, detector, 1.0::DOUBLE + ts_start_us // 1000000 % 4 AS w FROM found) GROUP BY score),
        t AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS below, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM s)
        SELECT round(CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (below + n / 2)) / (sum(p) * sum(n)) END, 6) AS roc_auc, round(CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(CASE WHEN tp > 0 THEN p * tp / (tp + fp) ELSE 0.0 END) / sum(p) END, 6) AS average_precision FROM t""",
    "cohort_select": _with(_EVENTS) + """, e AS (SELECT mmsi, count(*) AS reports FROM positions GROUP BY mmsi HAVING count(*) >= 6)
        SELECT mmsi, reports, 'labelled' AS part FROM e WHERE mmsi IN (SELECT mmsi FROM ext WHERE mmsi IS NOT NULL) UNION ALL
        SELECT * FROM (SELECT mmsi, reports, 'background' AS part FROM e WHERE mmsi NOT IN (SELECT mmsi FROM ext WHERE mmsi IS NOT NULL) ORDER BY sha256(mmsi) LIMIT 20)""",
    "stats_by_detector": _with(*_INCIDENTS) + "SELECT d.detector, count(incident_id) AS incidents, count(DISTINCT mmsi) AS vessels FROM (VALUES ('gap'), ('spoof'), ('loiter'), ('rendezvous'), ('anomaly')) d(detector) LEFT JOIN found ON found.detector = d.detector GROUP BY 1",
    "geoint_evidence": _with(*_INCIDENTS) + f"""SELECT incident_id, mmsi, detector, severity, reliability, CAST({_cut('score', [(0.85, '2'), (0.65, '3'), (0.45, '4'), (0.25, '5')], '6')} AS INTEGER) AS credibility,
        CAST(sha256(incident_id)[1:12] AS VARCHAR) AS public_id FROM found""",
}
