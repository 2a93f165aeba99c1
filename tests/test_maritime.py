"""The maritime engine on hand-made cases and against brute force."""

import json
import zipfile
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import geo, grading, parsing, zones
from tidewatch.operators import anomaly, detect, downsample, dwelling, evaluate, fusion, intervals, matching, ordered, publish, tracks, upkeep
from tidewatch.sources import files, shared
from tidewatch.streaming import collector

T0 = 1_704_067_200_000_000
MIN = 60_000_000
SCHEMA = "id long, mmsi string, us long, lat double, lon double, sog double, heading double, nav_status string, source string, region string"


def _reports(spark, rows):
    """rows of (mmsi, minute, lat, lon, sog)."""
    return spark.createDataFrame([(k, m, T0 + int(t * MIN), float(a), float(o), s if s is None else float(s), 0.0, "0", "aisstream", "sg") for k, (m, t, a, o, s) in enumerate(rows)], SCHEMA)


def test_haversine_speed_heading(spark):
    d = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0, 3600.0, 350.0, 10.0), (0.0, 0.0, 1.0, 0.0, 0.0, 90.0, 270.0)], "a double, b double, c double, d double, s double, h double, k double")
    km = geo.haversine_km(*[F.col(x) for x in "abcd"])
    rows = d.select(km, geo.implied_speed_kn(km, F.col("s")), geo.heading_delta(F.col("h"), F.col("k"))).collect()
    assert abs(rows[0][0] - 111.19) < 0.5 and abs(rows[0][1] - rows[0][0] / 1.852) < 1e-9 and rows[0][2] == 20
    assert rows[1][1] == 0 and rows[1][2] == 180


def test_rings_follow_the_even_odd_rule(spark):
    def holds(lat, lon, ring):
        odd = False
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (a > lat) != (c > lat) and lon < (d - b) * (lat - a) / (c - a) + b:
                odd = not odd
        return odd

    bow = zones.ZONES[1][3]
    points = [(1.2 + 0.05 * i, 100.5 + 0.08 * j) for i in range(40) for j in range(40)]
    d = spark.createDataFrame(points, "lat double, lon double")
    got = d.select(geo.in_ring(F.col("lat"), F.col("lon"), bow), geo.in_ring(F.col("lat"), F.col("lon"), bow[:2])).collect()
    assert [r[0] for r in got] == [holds(a, o, bow) for a, o in points] and any(r[0] for r in got) and not any(r[1] for r in got)


def test_zone_priority(spark):
    d = spark.createDataFrame([(1.2, 103.8), (1.25, 103.95), (33.7, -118.2), (0.0, 0.0)], "lat double, lon double")
    lat, lon = F.col("lat"), F.col("lon")
    rows = d.select(zones.zone_of(lat, lon), zones.zones_of(lat, lon), zones.in_kind(lat, lon, "port")).collect()
    assert [r[0] for r in rows] == ["singapore-strait", "singapore-strait", "us-la-longbeach", None]
    assert rows[0][1] == ["singapore-strait", "singapore-anchorages", "phillip-channel"] and [r[2] for r in rows] == [True, True, True, False]
    assert zones.table(d.sparkSession).count() == 7


def test_cuts(spark):
    d = spark.createDataFrame([(0.85,), (0.8,), (0.649,), (0.1,)], "x double")
    rows = d.select(grading.grade(F.col("x")), grading.severity(F.col("x")), grading.risk_severity(F.col("x")), grading.credibility(F.col("x"))).collect()
    assert [tuple(r) for r in rows] == [("B", "critical", "critical", 2), ("B", "high", "critical", 3), ("C", "moderate", "high", 4), ("F", "low", "low", 6)]
    k = spark.createDataFrame([(1, 2), (0, 0)], "k int, n int")
    low, high = grading.wilson(F.col("k"), F.col("n"))
    a, b = k.select(F.round(low, 6), F.round(high, 6)).collect()
    assert tuple(a) == (0.094531, 0.905469) and tuple(b) == (None, None)


def test_segmentation_splits_only_beyond_an_hour(spark):
    p = _reports(spark, [("1", 0, 0, 0, 1), ("1", 60, 0, 0, 1), ("1", 120.1, 0, 0.1, 1), ("2", 0, 0, 0, 1)])
    rows = {(r["mmsi"], r["voyage"]): r for r in tracks.summaries(p).collect()}
    assert {k: r["point_count"] for k, r in rows.items()} == {("1", 0): 2, ("1", 1): 1, ("2", 0): 1}
    assert rows["1", 0]["track_id"].startswith("1:2024-01-01T00:00:00")


def test_shapes_of_many_reports_are_written_in_slices(spark, monkeypatch):
    p = _reports(spark, [(f"v{j}", 5.0 * k, 1.0 + k / 100, 103.0 + j / 10, 9) for j in range(9) for k in range(8)])
    rows = lambda made: sorted((r["mmsi"], r["voyage"], r["start_us"], tuple(map(tuple, r["sequence"]))) for r in made.collect())
    taken, plain = [], tracks.shapes
    monkeypatch.setattr(tracks, "shapes", lambda part: taken.append(part.count()) or plain(part))
    monkeypatch.setattr(tracks, "SLICE_REPORTS", 30)
    made = tracks.stored_shapes(p, "mmsi", "voyage", "start_us", "sequence")
    assert len(taken) == 3 and sum(taken) == 72 and max(taken) < 72
    assert rows(made) == rows(plain(p)) and made.columns == ["mmsi", "voyage", "start_us", "sequence"]


def test_shapes_ignore_heading():
    t = np.arange(12) * 300e6
    east = tracks.shape(t, np.zeros(12), np.linspace(0, 0.2, 12), np.full(12, 9.0), 16)
    north = tracks.shape(t, np.linspace(0, 0.2, 12), np.zeros(12), np.full(12, np.nan), 16)
    assert len(east[0]) == 33 and np.shape(east[1]) == (15, 4)
    assert np.allclose(east[0][:32], north[0][:32], atol=0.05) and east[0][32] == 9.0 and north[0][32] == 0.0
    assert tracks.shape(np.zeros(3), np.zeros(3), np.zeros(3), np.zeros(3), 4)[0] == [0.0] * 9


def test_simplified_line_keeps_ends_and_apex():
    kept = tracks.simplified(np.array([0, 0.001, 0.1, 0.001, 0]), np.array([0, 0.1, 0.2, 0.3, 0.4]), 0.2)
    assert {0, 2, 4} <= set(kept.tolist())


def test_gap_needs_time_distance_and_no_outage(spark):
    p = _reports(spark, [("1", 0, 1.2, 103.6, 9), ("1", 120, 1.2, 103.7, 9), ("2", 0, 1.2, 103.6, 9), ("2", 119, 1.2, 103.7, 9), ("3", 0, 1.2, 103.6, 9), ("3", 300, 1.2, 103.601, 9)])
    assert [r["mmsi"] for r in detect.gap_segments(p).collect()] == ["1"]
    none = spark.createDataFrame([(T0 + 120 * MIN, None)], "opened_us long, closed_us long")
    over = spark.createDataFrame([(T0 + 110 * MIN, None)], "opened_us long, closed_us long")
    assert detect.gap_segments(p, none).count() == 1 and detect.gap_segments(p, over).count() == 0
    assert "Window" not in detect.gap_segments(p, over)._jdf.queryExecution().optimizedPlan().toString()  # reports are sorted once, before
    (g,) = detect.gaps(p).collect()
    assert g["zone_id"] == "singapore-strait" and g["lat"] == 1.2 and g["lon"] == 103.6 and g["incident_id"] == f"gap-1-{T0 // 10**6}"


def test_coverage_verdicts(spark):
    gap = [("1", 0, 1.1, 103.1, 9), ("1", 180, 1.1, 103.4, 9)]
    busy = [(f"w{v}", 20 * k, 1.1, 103.05 + 0.03 * (k % 13), 9) for v in range(4) for k in range(13)]
    for rows, verdict in ((gap + busy, "vessel-attributed"), (gap, "coverage-explained"), (gap + [(f"w{v}", t, 9.0, 9.0, 9) for v in range(4) for t in (1, 2)], "coverage-explained")):
        p = _reports(spark, rows)
        (r,) = detect.coverage(detect.gap_segments(p), p).where("mmsi = '1'").collect()
        assert r["verdict"] == verdict and (r["witnesses"] == 4) == (verdict == "vessel-attributed")


def test_silences_of_one_corridor_are_looked_at_once(spark, monkeypatch):
    """15 vessels fall silent along one way, some are heard on it by their own report alone; counts equal a plain loop over all vessels."""
    rows = [(f"s{v:02d}", t, 5.1 + x + 0.001 * v, 80.1, 9) for v in range(15) for t, x in ((1, 0.0), (205, 1.6))]
    rows += [("s03", 100 + 60 * 24, 5.6, 80.1, 9)] + [(f"w{v}", t, 5.1 + 0.4 * v, 80.1, 9) for v in range(4) for t in (30, 61, 130)]
    p = _reports(spark, rows)
    tables, plain = [], detect.written
    monkeypatch.setattr(detect, "written", lambda rows: tables.append(plain(rows)) or tables[-1])
    got = {r["id"]: (r["witnesses"], r["witnessed"], r["ends"]) for r in detect.coverage(detect.gap_segments(p), p).collect()}
    heard = {(r["mmsi"], np.floor(r["lat"] / 0.25), np.floor(r["lon"] / 0.25), r["us"] // 3_600_000_000) for r in p.collect()}
    want, ways = {}, set()
    for r in detect.gap_segments(p).collect():
        hours = range(r["prev_us"] // 3_600_000_000, r["us"] // 3_600_000_000 + 1)
        cells = [tuple(np.floor((r[f"prev_{c}"] + (r[c] - r[f"prev_{c}"]) * (k / 11)) / 0.25) for c in ("lat", "lon")) for k in range(12)]
        each = [{m for m, y, x, h in heard if (y, x) == c and h in hours and m != r["mmsi"]} for c in cells]
        enough = [len(e) >= 2 for e in each]
        want[r["id"]] = (len(set().union(*each)), sum(enough), enough[0] + enough[11])
        ways.add((frozenset(cells), hours[0], hours[-1]))
    assert got == want and len(want) >= 15
    assert [t.count() for t in tables if t.columns[-1] == "corridor"] == [len(ways)] and len(ways) < len(want)


def test_spoof_and_no_time_no_speed(spark):
    p = _reports(spark, [("1", 0, 0, 0, 9), ("1", 0.5, 1, 0, 9), ("1", 0.5, 2, 0, 9), ("1", 600, 2.1, 0, 9)])
    assert [(r["incident_type"], r["reliability"]) for r in detect.spoofs(p).collect()] == [("duplicate identity", "B")]


def test_dwell_spans_are_greedy():
    us, lat = np.arange(14) * 10.0 * MIN, np.zeros(14)
    lon = np.array([0, 0.5] + [1.0] * 8 + [2.0] * 4)
    (span,) = dwelling.dwell_spans(us, lat, lon, np.full(14, 1.0), lambda a, b: False)
    assert span[:2] == (2, 9) and span[4] == 1.0
    assert not dwelling.dwell_spans(us, lat, lon, np.full(14, 0.4), lambda a, b: False)
    assert dwelling.dwell_spans(us, lat, lon, np.full(14, 1.0), lambda a, b: True)[0][5]


def _scan(us, lat, lon, sog, radius_km=2.0, minutes=60.0, slow=(0.5, 2.0)):
    """(first, last) of spans, report by report."""
    out, i, n = [], 0, len(us)
    while i < n:
        j = i + 1
        while j < n and float(dwelling.km_between(lat[i], lon[i], lat[j], lon[j])) <= radius_km:
            j += 1
        own = [v for v in sog[i:j] if not np.isnan(v)]
        mean = round(float(np.mean(own)), 9) if own else 0.0
        if j - i >= 2 and us[j - 1] - us[i] >= minutes * 60e6 and slow[0] <= mean <= slow[1]:
            out.append((i, j - 1))
            i = j
        else:
            i += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_dwelling_equals_a_plain_scan(seed):
    rng = np.random.default_rng(seed)
    n = 700
    step = rng.choice([0.0, 0.0003, 0.004, 0.05], n, p=[0.4, 0.4, 0.17, 0.03]) * (1 + seed % 2)
    turn = rng.uniform(0, 2 * np.pi, n)
    lat, lon = [0.2, 60.0, -33.0][seed % 3] + np.cumsum(step * np.cos(turn)), np.cumsum(step * np.sin(turn)) + (179.9 if seed == 4 else 20)
    us, sog = np.cumsum(rng.integers(1, 12, n)) * MIN, np.where(rng.random(n) < 0.1, np.nan, rng.uniform(0, 2.5, n))
    cuts = np.sort(rng.choice(np.arange(1, n), 5, replace=False)).tolist()
    end = np.repeat([*cuts, n], np.diff([0, *cuts, n]))
    got = [s[:2] for s in dwelling.dwell_spans(us, lat, lon, sog, lambda a, b: False, end=end)]
    want = [(a + i, a + j) for a, b in zip([0, *cuts], [*cuts, n], strict=True) for i, j in _scan(us[a:b], lat[a:b], lon[a:b], sog[a:b])]
    assert got == want and want


def test_a_moored_vessel_is_scanned_fast():
    import time

    n = 64_000
    rng = np.random.default_rng(3)
    lat, lon, us = 5 + rng.uniform(-1e-3, 1e-3, n), 80 + rng.uniform(-1e-3, 1e-3, n), np.arange(n) * 45_000_000
    began = time.time()
    assert dwelling.dwell_spans(us, lat, lon, np.zeros(n), lambda a, b: False) == []
    assert len(dwelling.dwell_spans(us, lat, lon, np.ones(n), lambda a, b: False)) == 1
    assert time.time() - began < 4


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_paths_stay_whole_across_batches(size):
    keys = np.repeat(["a", "a", "b", "c", "c"], [1, 9, 4, 1, 20])
    rows = pd.DataFrame({"mmsi": keys, "piece": np.repeat([0, 1, 0, 0, 1], [1, 9, 4, 1, 20]), "k": range(35)})
    frames = list(dwelling.whole_paths((rows.iloc[i : i + size] for i in range(0, 35, size)), ["mmsi", "piece"], 6))
    assert pd.concat(frames)["k"].tolist() == list(range(35)) and len(frames) > 1 - (size == 100)
    seen = [set(zip(f["mmsi"], f["piece"], strict=True)) for f in frames]
    assert sum(map(len, seen)) == 5
    assert dwelling.path_ends([rows["mmsi"].to_numpy(), rows["piece"].to_numpy()]).tolist() == [1] + [10] * 9 + [14] * 4 + [15] + [35] * 20


def _meeting(a, b, range_km, speed_kn, minutes, step_min):
    """The longest run of grid times at which two whole interpolated paths are both slow and near."""
    lo, hi = max(a["us"][0], b["us"][0]), min(a["us"][-1], b["us"][-1])
    if hi - lo < minutes * 60e6:
        return None
    grid = np.arange(lo, hi + 1, step_min * 60e6)
    x, y = ({c: np.interp(grid, p["us"], p[c]) for c in ("lat", "lon", "sog")} for p in (a, b))
    away = dwelling.km_between(x["lat"], x["lon"], y["lat"], y["lon"])
    good = np.concatenate([[False], (x["sog"] <= speed_kn) & (y["sog"] <= speed_kn) & (away <= range_km), [False]])
    starts, ends = np.flatnonzero(~good[:-1] & good[1:]), np.flatnonzero(good[:-1] & ~good[1:])
    if not len(starts):
        return None
    k = int(np.argmax(ends - starts))
    s, e = int(starts[k]), int(ends[k])
    if (e - s - 1) * step_min < minutes:
        return None
    return int(grid[s]), int(grid[e - 1]), float(x["lat"][s:e].mean()), float(x["lon"][s:e].mean()), (e - s - 1) * step_min, float(away[s:e].min())


def test_meetings_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for v in range(16):
        base, t = (5.0 + 0.3 * (v // 2) % 1.2, 80.0 + 0.05 * (v // 4)), float(rng.uniform(0, 20))
        for _ in range(30):
            rows.append((f"v{v:02d}", t, base[0] + rng.normal(0, 0.001), base[1] + rng.normal(0, 0.001), 5 if rng.random() < 0.1 else rng.uniform(0, 0.9)))
            t += float(rng.uniform(3, 25))
    p = _reports(spark, rows)
    paths = {m: {c: g.sort_values("us")[c].to_numpy(float) for c in ("us", "lat", "lon", "sog")} for m, g in p.toPandas().groupby("mmsi")}
    moving = [m for m, x in paths.items() if x["sog"].max() >= 3]
    want = {(a, b): _meeting(paths[a], paths[b], 0.5, 1.0, 30, 5) for a in moving for b in moving if a < b}
    want = {k: v for k, v in want.items() if v}
    assert want and set(want) <= {(r["a"], r["b"]) for r in detect.meeting_candidates(p).collect()}
    degree = pd.Series([x for k in want for x in k]).value_counts()
    got = {(r["a"], r["b"]): r["minutes"] for r in detect.meetings(p).collect()}
    assert got == {k: v[4] for k, v in want.items() if degree[k[0]] <= 2 and degree[k[1]] <= 2}
    every = detect.rendezvous(p).collect()
    assert len(every) == 2 * len(got)
    one = sorted(got)[0][0]
    focused = detect.rendezvous(p, spark.createDataFrame([(one,)], "mmsi string")).collect()
    pick = lambda rows: sorted((r["incident_id"], r["score"]) for r in rows if one in (r["mmsi"], r["counterpart_mmsi"]))
    assert pick(focused) == pick(every) and len(pick(focused)) == len(focused)


def test_a_crowd_is_judged_by_a_few_neighbours(spark, monkeypatch):
    """40 vessels at one place, 30 in a port, two pairs apart, one of them at a port's edge, and a vessel that leaps across the globe while slow: the meetings of all pairs, from a part of them."""
    rng = np.random.default_rng(7)
    home = {f"c{k:02d}": (5.0, 80.0) for k in range(40)} | {f"p{k:02d}": (1.23, 103.85) for k in range(30)} | {"q0": (6.0, 80.0), "q1": (6.0, 80.0), "r0": (1.1801, 103.85), "r1": (1.1799, 103.85), "z": (7.0, 80.0)}
    rows = []
    for v, (lat, lon) in home.items():
        for k in range(12):
            far = (-60.0, -170.0) if v == "z" and k == 6 else (2.0, 0.0) if v[0] == "p" and k == int(v[1:]) % 11 else (0.0, 0.0)
            rows.append((v, 9.0 * k + float(rng.uniform(0, 5)), lat + far[0] + rng.normal(0, 0.0003), lon + far[1] + rng.normal(0, 0.0003), 5 if k == 3 else 0.3))
    p = _reports(spark, rows)
    paths = {m: {c: g.sort_values("us")[c].to_numpy(float) for c in ("us", "lat", "lon", "sog")} for m, g in p.toPandas().groupby("mmsi")}
    want = {(a, b): _meeting(paths[a], paths[b], 0.5, 1.0, 30, 5) for a in paths for b in paths if a < b}
    want = {k: v[4] for k, v in want.items() if v and not detect.in_port(v[2], v[3])}
    degree = pd.Series([x for k in want for x in k]).value_counts()
    judged, plain = [], detect.moments_of
    monkeypatch.setattr(detect, "moments_of", lambda shared, *rest: judged.append(shared.select("a", "b").distinct().count()) or plain(shared, *rest))
    few = {k: v for k, v in want.items() if degree[k[0]] <= 2 and degree[k[1]] <= 2}
    assert len(few) >= 1 and degree["c00"] > 30
    assert {(r["a"], r["b"]): r["minutes"] for r in detect.meetings(p).collect()} == few
    assert sum(judged) < 1_100 < len(home) * (len(home) - 1) // 2
    q = spark.createDataFrame([("q1",)], "mmsi string")
    assert {(r["a"], r["b"]) for r in detect.meetings(p, focus=q).collect()} == {k for k in few if "q1" in k}


def test_many_legs_are_looked_at_in_slices_of_half_hours(spark, monkeypatch):
    """A crowd, a pair apart, and a run over many half hours: the same meetings from slices, of which each holds a part of the half hours."""
    at = {f"c{k:02d}": 80.0 for k in range(12)} | {"q0": 82.0, "q1": 82.0}
    p = _reports(spark, [(v, 9.0 * k + j % 5, 5.0 + j / 1e5, lon, 5 if k == 0 else 0.3) for j, (v, lon) in enumerate(at.items()) for k in range(22)])
    cols = ("a", "b", "ts_start_us", "ts_end_us", "minutes", "km", "region")
    found = lambda: sorted(tuple(r[c] for c in cols) + (round(r["lat"], 9), round(r["lon"], 9)) for r in detect._enough_meetings(p, 0.5, 1.0, 30, 2, 5).collect())
    whole = found()
    bins, plain = [], detect.moments_of
    monkeypatch.setattr(detect, "moments_of", lambda shared, legs, *rest: bins.append({r["bin"] for r in legs.select("bin").distinct().collect()}) or plain(shared, legs, *rest))
    monkeypatch.setattr(detect, "SLICE_LEGS", 100)
    assert found() == whole and ("q0", "q1") in {r[:2] for r in whole}
    assert len(bins) > 3 and max(map(len, bins)) <= len(set.union(*bins)) // 2


def test_times_of_a_pair_are_counted_out_after_its_legs_are_there(spark):
    """Two vessels side by side for three hours, but for one report: their runs span half hours, and grid times travel in none of the joins."""
    p = _reports(spark, [(v, 9.0 * k + d, 5.0 + (0.1 if v == "v1" and k == 12 else 0.0), 80.0 + d / 1e5, 4 if k == 0 else 0.3) for v, d in (("v0", 0.0), ("v1", 2.0)) for k in range(22)])
    met = detect.near_moments(p)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(sequence(k0") < plan.index("Join")
    ks = np.array(sorted(r["k"] for r in met.collect()))
    runs = np.split(ks, np.flatnonzero(np.diff(ks) > 1) + 1)
    assert len(runs) == 2 and [r["minutes"] for r in detect.meetings(p).collect()] == [5.0 * (max(len(r) for r in runs) - 1)]


def test_near_moments_by_slices_are_the_same(spark, monkeypatch):
    """Slices of the half hours give the moments of all at once; their own tables are gone when the next one begins."""
    rows = [(f"v{v:02d}", 9.0 * k + v % 4, 5.0 + v % 3 / 2e3, 80.0 + v / 1e5, 4 if k == 0 else 0.3) for v in range(12) for k in range(12)]
    p = _reports(spark, rows)
    found = lambda: sorted((r["a"], r["b"], r["k"], r["us"], r["lat"], r["lon"], r["km"]) for r in detect.near_moments(p).collect())
    whole, looked, plain = found(), [], detect.moments_of
    monkeypatch.setattr(detect, "moments_of", lambda shared, legs, *rest: looked.append({r["bin"] for r in legs.select("bin").distinct().collect()}) or plain(shared, legs, *rest))
    monkeypatch.setattr(detect, "SLICE_PAIRS", 100)
    with shared.scope(spark):
        assert found() == whole and len(whole) > 500
    assert len(looked) > 2 and not looked[0] & looked[1]


@pytest.mark.parametrize("lon", [179.9995, -179.9995, 20.0])
def test_meetings_across_the_meridian(spark, lon):
    other = {179.9995: -179.9995, -179.9995: 179.9995, 20.0: 20.001}[lon]
    rows = [(v, t, 0.0, x, 5 if t == 0 else 0.2) for v, x in (("a", lon), ("b", other)) for t in range(0, 121, 10)]
    p = _reports(spark, rows)
    assert [(r["a"], r["b"]) for r in detect.meeting_candidates(p).collect()] == [("a", "b")]
    (m,) = detect.meetings(p).collect()
    assert m["minutes"] >= 60 and abs(m["lon"]) <= 180 and m["km"] < 0.2
    # a path that crosses the meridian between two reports stays there, it doesn't sweep the globe
    q = _reports(spark, [("a", t, 0.0, 179.9995 if t % 20 else -179.9995, 5 if t == 0 else 0.2) for t in range(0, 121, 10)] + [("b", t, 0.0, 10.0, 5 if t == 0 else 0.2) for t in range(0, 121, 10)])
    assert detect.meeting_candidates(q).count() == 0


def test_pieces_change_no_dwelling(spark):
    rng = np.random.default_rng(2)
    rows, lat = [], 5.0
    for t in range(0, 3000, 10):
        lat += float(rng.choice([0.0, 0.001, 0.05], p=[0.7, 0.25, 0.05]))
        rows.append(("1", t, lat, 80.0, float(rng.uniform(0.3, 2.2))))
    p = _reports(spark, rows)
    us, la, lo, sog = (np.array(x, float) for x in zip(*[(T0 + int(t * MIN), a, o, s) for _, t, a, o, s in rows], strict=True))
    want = [(int(us[i]), int(us[j])) for i, j, *_ in dwelling.dwell_spans(us, la, lo, sog, lambda a, b: False)]
    got = sorted((r["ts_start_us"], r["ts_end_us"]) for r in detect.loiters(p).collect())
    assert want and got == want and detect.pieces(p).select("piece").distinct().count() > 3


def test_intervals(spark):
    df = lambda rows: spark.createDataFrame(rows, "key string, start_us long, end_us long")
    merged = intervals.merged(df([("a", 0, 5), ("a", 5, 7), ("a", 9, 10), ("b", 1, 2), ("b", 1, 1)]))
    assert sorted(map(tuple, merged.collect())) == [("a", 0, 7), ("a", 9, 10), ("b", 1, 2)]
    rest = intervals.subtracted(df([("a", 0, 10)]), df([("a", 3, 5), ("a", 4, 6), ("b", 0, 99)]))
    assert sorted(map(tuple, rest.collect())) == [("a", 0, 3), ("a", 6, 10)]


def test_event_matches_end_in_each_state(spark):
    p = _reports(spark, [(m, t, 1.2, 103.7, 9) for m in ("1", "2") for t in range(0, 60, 10)] + [("3", t, 40, 10, 9) for t in range(0, 60, 10)])
    e = spark.createDataFrame([("named", "gap", "1", T0, 1.2, 103.7), ("unclear", "gap", None, T0, 1.2, 103.7), ("none", "gap", None, T0, -30.0, 0.0), ("far", "gap", "3", T0, 1.2, 103.7)], "event_id string, kind string, mmsi string, ts_us long, lat double, lon double")
    got = {}
    for r in matching.event_matches(e, tracks.summaries(p)).collect():
        got.setdefault(r["event_id"], []).append(r["status"])
    assert got == {"named": ["matched"], "unclear": ["ambiguous"] * 2, "none": ["unmatched"], "far": ["matched"]}


def test_upkeep(spark):
    p = _reports(spark, [("1", 0, 0, 0, 1), ("1", 0, 0, 1, 2), ("2", 0, 0, 0, 1)])
    kept = upkeep.new_positions(p, p.where("mmsi = '2'")).collect()
    assert [(r["mmsi"], r["lon"]) for r in kept] == [("1", 1.0)]
    v = "mmsi string, first_us long, last_us long, name string, length double"
    old, new = spark.createDataFrame([("1", 5, 9, "", 0.0)], v), spark.createDataFrame([("1", 3, 7, "N", 80.0), ("2", 1, 1, None, None)], v)
    assert sorted(map(tuple, upkeep.upserted(old, new).collect())) == [("1", 3, 9, "N", 80.0), ("2", 1, 1, None, None)]
    i = "incident_id string, mmsi string, counterpart_mmsi string, score double"
    stored = spark.createDataFrame([("a", "1", None, 0.1), ("b", "2", "1", 0.2), ("c", "3", None, 0.3)], i)
    fresh = spark.createDataFrame([("a", "1", None, 0.9)], i)
    assert sorted((r["incident_id"], r["score"]) for r in upkeep.replaced(stored, fresh, spark.createDataFrame([("1",)], "mmsi string")).collect()) == [("a", 0.9), ("c", 0.3)]


def _auc(s, y, w):
    """ROC AUC and average precision from all pairs and a plain sweep."""
    wins = sum(w[i] * w[j] * (1.0 if s[i] > s[j] else 0.5 if s[i] == s[j] else 0.0) for i in np.flatnonzero(y) for j in np.flatnonzero(~y))
    steps = sum(w[y & (s == t)].sum() * w[y & (s >= t)].sum() / w[s >= t].sum() for t in np.unique(s) if w[y & (s == t)].sum())
    return wins / (w[y].sum() * w[~y].sum()), steps / w[y].sum()


@pytest.mark.parametrize("places", [1, 17])
def test_weighted_auc(spark, places):
    rng = np.random.default_rng(1)
    s, y, w = np.round(rng.random(60), places), rng.random(60) < 0.4, rng.integers(1, 4, 60).astype(float)
    d = spark.createDataFrame([(float(a), bool(b), float(c)) for a, b, c in zip(s, y, w, strict=True)] + [(None, True, 1.0), (0.5, None, 1.0)], "score double, y boolean, w double")
    (r,) = evaluate.weighted_auc(d, "score", "y", "w").collect()
    assert np.allclose([r["roc_auc"], r["average_precision"]], _auc(s, y, w), atol=1e-6)
    assert evaluate.weighted_auc(d.where("y"), "score", "y", "w").first()["roc_auc"] is None


def test_scores_that_differ_in_the_fifth_place_are_told_apart(spark):
    d = spark.createDataFrame([(0.50001, True, 1.0), (0.50002, False, 1.0), (0.50003, True, 1.0), (0.50004, False, 1.0)], "score double, y boolean, w double")
    assert evaluate.weighted_auc(d, "score", "y", "w").first()["roc_auc"] == 0.25


def test_running_sums_cross_partitions(spark):
    rng = np.random.default_rng(4)
    v = rng.permutation(500)
    d = spark.createDataFrame([(int(x), int(x) % 7) for x in v], "x long, y long")
    got = {r["x"]: (r["before"], r["place"]) for r in ordered.numbered(ordered.running(d, ["x"], {"before": F.col("y")}, 9), "x").collect()}
    assert got == {x: (sum(k % 7 for k in range(x)), x + 1) for x in range(500)}
    assert ordered.running(d.limit(0), ["x"], {"before": F.col("y")}).count() == 0


def test_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(x)) for x in rng.integers(0, 9, 300)] + [("b", float(x)) for x in rng.normal(size=37)] + [("c", 1.5), ("d", None), (None, 2.0), (None, 4.0), ("e", float("nan")), ("e", 1.0), ("e", 0.0), ("=", 3.0)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"q0": 0.0, "q1": 0.37, "q2": 0.5, "q3": 0.99, "q4": 1.0}
    text = lambda rows: sorted(str(tuple(r)) for r in rows)
    for by in (["g"], []):
        plain = d.where("v IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n"), *[F.percentile("v", F.lit(q)).alias(k) for k, q in shares.items()])
        assert text(ordered.quantiles(d, "v", shares, by).collect()) == text(plain.collect())
    assert ordered.quantiles(d.limit(0), "v", shares).count() == 0


def test_detectors_leave_only_their_findings(spark):
    p = _reports(spark, [("1", 0, 1.2, 103.6, 9), ("1", 130, 1.2, 103.9, 9), ("1", 130.4, 3.0, 103.9, 9)])
    with shared.scope(spark):
        found = detect.all_incidents(p)
        left = [x for x in shared._scopes[-1] if shared.exists(spark, x)]
        assert len(left) == 4 and found.count() == 2


def test_few_events_are_broadcast_to_reports_and_tracks(spark):
    p = _reports(spark, [(str(v), 20 * k, 1.3, 103.8, 5) for v in (1, 2) for k in range(8)])
    e = spark.createDataFrame([("named", "spoof", "1", T0 + 5 * MIN, 1.3, 103.8), ("free", "spoof", None, T0 + 5 * MIN, 1.3, 103.8)], "event_id string, kind string, mmsi string, ts_us long, lat double, lon double")
    seen = spark.createDataFrame([(T0 - 600 * MIN, T0 + 600 * MIN)], "start_us long, end_us long")
    made = matching.event_matches_by_path(e, tracks.summaries(p), p, seen)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Hint=(strategy=broadcast)") >= 3
    assert {(r["event_id"], r["track_id"][0], r["status"]) for r in made.collect()} == {("named", "1", "matched"), ("free", "1", "ambiguous"), ("free", "2", "ambiguous")}


def test_fusion(spark):
    p = _reports(spark, [("1", 0, 1.2, 103.6, 9), ("1", 130, 1.2, 103.9, 9), ("1", 130.4, 3.0, 103.9, 9)])
    (r,) = fusion.fuse(detect.all_incidents(p)).collect()
    assert r["detectors"] == "gap,spoof" and r["n_incidents"] == 2 and 0 < r["risk"] <= 1 and r["best_reliability"] == "B"
    assert fusion.evidence(detect.all_incidents(p)).where("summary IS NULL").count() == 0


def test_downsampling():
    last = (0, 10.0, 5.0, "0")
    assert downsample.news(None, last) and not downsample.news(last, (44_000_000, 29.9, 6.9, "0"))
    assert downsample.news(last, (45_000_000, 10.0, 5.0, "0")) and downsample.news(last, (1, 350.0, 5.0, "0")) and downsample.news(last, (1, 10.0, 7.0, "0")) and downsample.news(last, (1, 10.0, 5.0, "1"))
    assert not downsample.news(last, (-99_000_000, None, float("nan"), "0"))


def _message(kind, mmsi, second, heading=10.0, sog=5.0, lat=1.2):
    body = {"PositionReport": {"Sog": sog, "Cog": 1.0, "TrueHeading": heading, "NavigationalStatus": "0"}} if kind == "PositionReport" else {"ShipStaticData": {"Name": " X ", "Type": 70, "Dimension": {"A": 10, "B": 5, "C": 0, "D": 0}}}
    return json.dumps({"MessageType": kind, "MetaData": {"MMSI": mmsi, "ShipName": "", "latitude": lat, "longitude": 103.7, "time_utc": f"2024-01-01 12:00:{second:02d}.000000000 +0000 UTC"}, "Message": body})


def test_downsampling_in_parts_equals_one_pass(spark):
    rng = np.random.default_rng(9)
    rows, k = [], 0
    for v in range(4):
        us = T0
        for _ in range(400):
            us += int(rng.choice([0, 5, 20, 44, 45, 90, 4000])) * 1_000_000
            rows.append((k, f"v{v}", us, None if rng.random() < 0.1 else float(rng.choice([0, 10, 19, 30, 350])), None if rng.random() < 0.1 else float(rng.choice([1.0, 2.5, 3.5])), str(int(rng.random() < 0.05))))
            k += 1
    d = spark.createDataFrame(rows, "id long, mmsi string, us long, heading double, sog double, nav_status string")
    for limits in ({}, {"seconds": 100.0, "turn": 30.0}):
        want = []
        for v in range(4):
            own = pd.DataFrame([r for r in rows if r[1] == f"v{v}"], columns=["id", "mmsi", "us", "heading", "sog", "nav_status"]).sort_values(["us", "id"])
            want += own["id"][downsample.accepted(own, None, **limits)[0]].tolist()
        assert sorted(r["id"] for r in downsample.downsampled(d.repartition(5), **limits).collect()) == sorted(want)


def test_a_track_that_an_incident_names_stays(spark):
    made = spark.createDataFrame([("1", "1:a", 0, 10), ("1", "1:b", 20, 30)], "mmsi string, track_id string, start_us long, end_us long")
    found = spark.createDataFrame([("i", "1", 2, 4, "1:z"), ("j", "1", 21, 22, None), ("k", "1", 5, 6, "")], "incident_id string, mmsi string, ts_start_us long, ts_end_us long, track_id string")
    assert {r["incident_id"]: (r["track_id"], r["overlap_us"]) for r in matching.incident_tracks(found, made).collect()} == {"i": ("1:z", None), "j": ("1:b", 1), "k": ("1:a", 1)}


def test_stream_is_parsed_and_downsampled(spark, tmp_path):
    (tmp_path / "in").mkdir()
    first = [_message("PositionReport", 563000001, s, heading=511.0) for s in (0, 10, 50)] + [_message("ShipStaticData", 563000001, 0), _message("PositionReport", 563000002, 0, lat=99.0), "no json"]
    (tmp_path / "in" / "a.txt").write_text("\n".join(first))
    messages = collector.parsed(spark.read.text(str(tmp_path / "in")))
    assert {r["heading"] for r in collector.reports(messages).collect()} == {None} and collector.reports(messages).count() == 3
    ship = collector.identities(messages.where("MessageType = 'ShipStaticData'")).first()
    assert (ship["name"], ship["ship_type"], ship["flag"], ship["length"], ship["width"]) == ("X", "cargo", "SG", 15.0, None)
    rows = collector.downsample_stream(collector.reports(collector.parsed(spark.readStream.text(str(tmp_path / "in")))))

    def collect(batch, number):
        batch.write.mode("append").parquet(str(tmp_path / "out"))

    collector.start(rows, collect, str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in" / "b.txt").write_text(_message("PositionReport", 563000001, 58, heading=511.0) + "\n" + _message("PositionReport", 563000001, 59, sog=8.0, heading=511.0))
    collector.start(rows, collect, str(tmp_path / "cp")).awaitTermination()
    got = sorted(r["us"] // 1_000_000 % 60 for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [0, 50, 59]


def test_outages_of_a_feed(spark):
    d = spark.createDataFrame([("f", 0), ("f", 60_000_000), ("f", 300_000_000)], "key string, us long")
    assert [tuple(r) for r in collector.outages(d).collect()] == [("f", 150_000_000, 300_000_000)]


CSV = "﻿MMSI,BaseDateTime,LAT,LON,SOG,VesselName,VesselType,Length\n366000001,2023-01-01T00:00:03,33.70,-118.20,12.1,CARGO,70,200\n366000001,2023-01-01 00:05:03,33.71,-118.20,,,30,x\n366000002,2023-01-01T00:00:03,,,1,A,52,1\n"


def test_csv_and_zip(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV, encoding="utf-8")
    raw = files.report_csv(spark, str(tmp_path / "a.csv"))
    got = files.positions(raw, "us-west").orderBy("us").collect()
    assert [(r["mmsi"], r["sog"], r["heading"]) for r in got] == [("366000001", 12.1, None), ("366000001", None, None)]
    ship = {r["mmsi"]: r for r in files.vessels(raw).collect()}["366000001"]
    assert ship["name"] == "CARGO" and ship["ship_type"] == "cargo" and ship["flag"] == "US" and ship["length"] == 200.0
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/a.csv", CSV)
    zipped = files.zipped_csv(spark, str(tmp_path / "a.zip"), "mmsi string, basedatetime string, lat string, lon string")
    assert files.positions(zipped, "us-west").count() == 2
    assert files.within(files.positions(raw, "x"), 33, -119, 33.705, -118).count() == 1


def test_event_pages(spark):
    page = {"entries": [{"id": "1", "type": "ENCOUNTER", "start": "2024-01-01T00:00:00Z", "end": None, "position": {"lat": 1.0, "lon": 2.0}, "vessel": {"ssvid": "9"}, "encounter": {"vessel": {"ssvid": "8"}}}, {"id": "2", "type": "other"}]}
    (r,) = files.event_pages(spark.createDataFrame([(json.dumps(page),)], "value string")).collect()
    assert (r["kind"], r["mmsi"], r["counterpart_mmsi"]) == ("rendezvous", "9", "8") and r["ts_start"].replace(tzinfo=timezone.utc) == datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_live_time_needs_a_fraction(spark):
    d = spark.createDataFrame([("2024-01-01 12:00:00.000000000 +0000 UTC",), ("2024-01-01 12:00:00 +0000 UTC",)], "x string")
    assert [r[0] is None for r in d.select(parsing.live_timestamp(F.col("x"))).collect()] == [False, True]


def test_sequence_model_learns_and_survives_saving(tmp_path):
    rng = np.random.default_rng(0)
    x = np.stack([np.stack([np.ones(15), rng.normal(0, 0.1, 15), np.ones(15), rng.normal(0, 0.05, 15)], axis=1) for _ in range(40)])
    model = anomaly.SequenceModel().fit(x, epochs=60).calibrate(x)
    assert model.parameters == 804
    odd = x[:5].copy()
    odd[:, 5:, 3] += 2.0
    assert model.errors(odd).min() > model.errors(x).max() and (model.errors(x) > model.threshold).mean() <= 0.05
    sha = model.save(str(tmp_path / "m.npz"))
    assert np.allclose(anomaly.SequenceModel.load(str(tmp_path / "m.npz"), sha).errors(x), model.errors(x))
    with pytest.raises(ValueError):
        anomaly.SequenceModel.load(str(tmp_path / "m.npz"), "0" * 64)


def test_gradients_of_the_sequence_model():
    x = np.random.default_rng(3).normal(size=(3, 5, 4))
    m = anomaly.SequenceModel(hidden=3)
    m.mean, m.scale = np.zeros(4), np.ones(4)
    m._start(4)
    _, g = m._gradients(x)
    for k, v in m.p.items():
        at = tuple(0 for _ in v.shape)
        old = v[at]
        v[at] = old + 1e-5
        up = m._gradients(x)[0]
        v[at] = old - 1e-5
        down = m._gradients(x)[0]
        v[at] = old
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6, k


def test_publishing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.23456)], "name string, lat double")
    assert publish.write(rows, str(tmp_path / "x.json"), ("name",)) > 0 and json.loads((tmp_path / "x.json").read_text()) == [{"name": "a", "lat": 1.2346}]
    with pytest.raises(ValueError):
        publish.checked({"api_key": 1})
    shown = spark.createDataFrame([("x", 0.5, None, 2.0)], "id string, score double, lat double, lon double")
    feature = spark.createDataFrame([(json.dumps({"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1.0, 2.0]]}}),)], "feature string")
    one = lambda **v: spark.createDataFrame([tuple(v.values())], list(v))
    runs = spark.createDataFrame([(1, 0.5), (9, 0.75)], "created_us long, precision double")
    made = publish.documents(one(mode="live", last_report_us=1), one(vessels=1, tracks=2, incidents=3, incidents_by_detector={"gap": 3}), feature, shown, runs, {"sha256": "ab", "threshold": 0.1, "parameters": 804}, 7)
    sizes = publish.snapshot(spark, made, str(tmp_path / "public"))
    read = {n: json.loads((tmp_path / "public" / f"{n}.json").read_text()) for n in sizes}
    assert sorted(read) == ["evaluations", "incidents", "model", "stats", "status", "tracks"] and all(len((tmp_path / "public" / f"{n}.json").read_bytes()) == v for n, v in sizes.items())
    assert read["evaluations"]["evaluation"]["precision"] == 0.75 and read["stats"]["incidents_by_detector"] == {"gap": 3} and read["incidents"]["incidents"][0]["lat"] is None
    assert publish.snapshot(spark, made, str(tmp_path / "public")) == sizes  # over what stands there
    assert publish.documents(one(mode="live"), one(vessels=1), feature, shown, runs.limit(0), {}, 7)["evaluations"]["evaluation"] == {"status": "collecting"}
    for worse in (made | {"model": {"sha256": "ab"}}, made | {"stats": made["stats"] | {"incidents_by_detector": {"s3://bucket": 1}}}):
        with pytest.raises(ValueError):
            publish.snapshot(spark, worse, str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()  # nothing is written unless all is right
    with pytest.raises(ValueError):
        publish.write(rows, str(tmp_path / "y.json"), ("other",))
    p = _reports(spark, [("1", k, 1 + k / 1000, 103, 9) for k in range(40)])
    (line,) = publish.lines(tracks.voyages(p), 10).collect()
    points = json.loads(line["feature"])["geometry"]["coordinates"]
    assert len(points) == 10 and points[0] == [103.0, 1.0] and points[-1] == [103.0, 1.039]


def test_refreshed_tables_equal_a_full_build(spark):
    from tidewatch.operators import incremental

    rows = [(m, t, 1.2, 103.6 + t / 4000, 9) for m in ("1", "2") for t in (0, 10, 20, 200, 210, 330, 340)] + [("3", 5, 1.2, 103.6, 9)]
    p = _reports(spark, rows)
    early = p.where(F.col("us") < T0 + 205 * MIN)
    stored = tracks.summaries(early)
    dirty = upkeep.dirty_backlog(p, stored)
    assert sorted(r["mmsi"] for r in dirty.collect()) == ["1", "2"]
    shown = lambda df: sorted((r["track_id"], r["voyage"], r["point_count"]) for r in df.collect())
    assert shown(incremental.refreshed_tracks(p, stored, dirty)) == shown(tracks.summaries(p))
    ids = lambda df: sorted(r["incident_id"] for r in df.collect())
    assert ids(incremental.refreshed_incidents(p, detect.all_incidents(early), dirty)) == ids(detect.all_incidents(p))


def test_agreement_and_external_rates(spark):
    a, b = (spark.createDataFrame(x, "track_id string, label string") for x in ([("1", "odd"), ("2", "odd"), ("3", "fine")], [("1", "odd"), ("2", "fine")]))
    assert [tuple(r) for r in evaluate.agreement(a, b).collect()] == [("odd", 2, 1)]
    i = spark.createDataFrame([("a", "gap"), ("b", "gap"), ("c", "spoof")], "incident_id string, detector string")
    assert sorted(tuple(r) for r in evaluate.external_rates(i, i.where("incident_id = 'a'")).collect()) == [("gap", 2, 1, 0.5), ("spoof", 1, 0, 0.0)]


def test_threshold_comes_from_all_voyages(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (2600, 2, 4)) * rng.gamma(1, 1, (2600, 1, 1))
    rows = [(f"{k:04d}", 0, T0, [], v.tolist()) for k, v in enumerate(x)]
    shapes = spark.createDataFrame(rows, "mmsi string, voyage long, start_us long, features array<double>, sequence array<array<double>>")
    model = anomaly.fitted(shapes)
    errors = model.errors(x)
    assert abs(model.threshold - np.percentile(errors, 99)) < 1e-9 and anomaly.scored(shapes, model).where(F.col("error") > model.threshold).count() == 26


def test_events_match_the_whole_path(spark):
    p = _reports(spark, [("1", t, 1.2, 103 + t / 60, 9) for t in range(0, 181, 10)] + [("2", t, 40, 10, 9) for t in range(0, 60, 10)]).withColumn("imo", F.when(F.col("mmsi") == "2", "I2"))
    rows = [("mid", None, None, T0 + 90 * MIN, 1.2, 104.5), ("nobody", "9", None, T0, 1.2, 103.0), ("imo", None, "I2", T0, 1.2, 103.0), ("late", None, None, T0 + 2000 * MIN, 1.2, 104.5), ("strange", None, "I9", T0, 1.2, 104.0)]
    e = spark.createDataFrame(rows, "event_id string, mmsi string, imo string, ts_us long, lat double, lon double").withColumn("kind", F.lit("gap"))
    seen = spark.createDataFrame([("sg", T0, T0 + 600 * MIN)], "key string, start_us long, end_us long")
    t = tracks.summaries(p)
    got = {r["event_id"]: r for r in matching.event_matches_by_path(e, t, p, seen).collect()}
    assert {k: (r["status"], (r["track_id"] or "")[:1], r["in_observed_coverage"]) for k, r in got.items()} == {
        "mid": ("matched", "1", True), "nobody": ("unmatched", "", True), "imo": ("matched", "2", True), "late": ("unmatched", "", False), "strange": ("matched", "1", True),
    }
    assert got["mid"]["rank_value"] == 0.0
    assert {r["event_id"]: r["status"] for r in matching.event_matches(e.drop("imo"), t).collect()}["mid"] == "unmatched"


def test_review_pools_in_order(spark):
    t = spark.createDataFrame([(k, k, 0) for k in "abcdefg"], "track_id string, mmsi string, voyage long")
    found = spark.createDataFrame([("1", "spoof", 0.7, (99.0,)), ("2", "loiter", 0.7, (None,)), ("3", "gap", 0.5, (9.0,)), ("4", "spoof", 0.9, (99.0,)), ("5", "anomaly", 0.7, (None,))], "incident_id string, detector string, score double, evidence struct<implied_speed_kn:double>")
    of = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", "d"), ("5", "e")], "incident_id string, track_id string")
    m = spark.createDataFrame([("x", "d", "ambiguous"), ("y", None, "unmatched")], "event_id string, track_id string, status string")
    errors = spark.createDataFrame([("b", 0, 1.0), ("f", 0, 0.8), ("g", 0, 1.3)], "mmsi string, voyage long, error double")
    pools = evaluate.review_pools(t, of, found, m, errors, 1.0)
    got = {r["track_id"]: r["stratum"] for r in pools.collect()}
    queue = evaluate.review_queue(pools, {"alert": 1, "ais-artifact-candidate": 1, "external-event": 1, "near-threshold": 1}, 5, 1).collect()
    assert sorted(r["stratum"] for r in queue) == ["ais-artifact-candidate", "alert", "external-event", "near-threshold", "rest"]
    assert {r["stratum"]: r["probability"] for r in queue}["ais-artifact-candidate"] == 0.5 and sorted(r["queue_order"] for r in queue) == [1, 2, 3, 4, 5]
    assert got == {"a": "ais-artifact-candidate", "b": "alert", "c": "ais-artifact-candidate", "d": "external-event", "e": "alert", "f": "near-threshold", "g": "rest"}
