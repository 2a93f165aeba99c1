"""Feeds, labels, books, rebuilds and frozen models on hand-made cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import anomaly, detect, feeds, incremental, labels, overlap, publish, rebuild, tracks
from tidewatch.sources import files
from tidewatch.streaming import ledger

T0, MIN = 1_704_067_200_000_000, 60_000_000
SCHEMA = "id long, mmsi string, us long, lat double, lon double, sog double, region string"


def _reports(spark, rows):
    return spark.createDataFrame([(k, m, T0 + int(t * MIN), float(a), float(o), float(s), "sg") for k, (m, t, a, o, s) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("most", [0, 1000])
def test_intervals_meet_by_broadcast_and_by_days(spark, most):
    rng = np.random.default_rng(1)
    day = 86_400_000_000
    left = [(k, a, a + b) for k, (a, b) in enumerate(zip(rng.integers(0, 9 * day, 40).tolist(), rng.integers(1, 2 * day, 40).tolist(), strict=True))]
    right = [(a, None if k == 0 else a + b) for k, (a, b) in enumerate(zip(rng.integers(0, 12 * day, 15).tolist(), rng.integers(1, day, 15).tolist(), strict=True))]
    got = overlap.overlapping(spark.createDataFrame(left, "id long, s long, e long"), spark.createDataFrame(right, "from_us long, to_us long"), "s", "e", "id", most)
    want = {(i, f) for i, s, e in left for f, t in right if f < e and (t is None or t > s)}
    assert {(r["id"], r["from_us"]) for r in got.collect()} == want and got.count() == len(want)


def test_feeds_filter_sort_and_keep_evidence_apart(spark):
    p = _reports(spark, [("1", 0, 1.2, 103.8, 9), ("1", 180, 1.6, 103.8, 9), ("2", 0, 5, 80, 9), ("2", 1, 8, 80, 9)])
    found = detect.all_incidents(p)
    assert "evidence" not in feeds.incident_feed(found).columns and "evidence" in feeds.incident_feed(found, full=True).columns
    assert [r["mmsi"] for r in feeds.incident_feed(found, detector="gap").collect()] == ["1"]
    assert feeds.incident_feed(found, region="nowhere").count() == 0
    item = {r["mmsi"]: r for r in feeds.evidence_feed(found).collect()}
    assert "silent for 180.0 min" in item["1"]["summary"] and "Singapore Strait" in item["1"]["summary"] and len(item["1"]) == 17
    assert feeds.evidence_feed(found, min_score=1.1).count() == 0
    (line,) = feeds.vessel_feature(p, "1").collect()
    assert json.loads(line["feature"])["geometry"]["coordinates"] == [[103.8, 1.2], [103.8, 1.6]] and feeds.vessel_feature(p, "9").count() == 0


def test_freshness(spark):
    rows = spark.createDataFrame([(9.9,), (10.0,), (30.0,), (30.1,), (None,)], "m double")
    assert [r[0] for r in rows.select(feeds.freshness(F.col("m"))).collect()] == ["live", "delayed", "delayed", "collector offline", "collector offline"]


def test_imo_under_any_name(spark):
    rows = ['{"imo": 7}', '{"IMO": "8"}', '{"MetaData": {"imo": 9}}', '{"ImoNumber": ""}', "no json", None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in rows], "raw string").select(labels.raw_imo(F.col("raw"))).collect()] == ["7", "8", "9", None, None, None]


def test_partitions_are_replaced_and_cleared(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x")], "v long, region string, detector string")
    rebuild.replace_partitions(rows, path, "region", "detector")
    rebuild.replace_partitions(rows.where("v = 1").withColumn("v", F.lit(9).cast("long")), path, "region", "detector")
    read = lambda: sorted(r["v"] for r in spark.read.parquet(path).collect())
    assert read() == [2, 3, 9]
    rebuild.clear_partitions(rows.where("v = 2"), path, "region", "detector", region="a")
    assert read() == [2, 3]


def test_cleared_partitions_have_escaped_names(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a/b c%", "x:1", 1), ("a/b c%", "y", 2), ("z", "y", 3)], "region string, detector string, v int")
    rebuild.replace_partitions(rows, path, "region", "detector")
    rebuild.clear_partitions(rows.where("v = 2"), path, "region", "detector", region="a/b c%")
    assert sorted(r["v"] for r in spark.read.schema(rows.schema).parquet(path).collect()) == [2, 3]


def test_only_the_pinned_model_scores(spark, tmp_path):
    rng = np.random.default_rng(3)
    p = _reports(spark, [(f"v{v}", 10 * t, 5 + v + 0.01 * t, 80 + 0.01 * t * (3 if v == 5 else 1) + float(rng.normal(0, 1e-4)), 9) for v in range(8) for t in range(12)])
    shapes, made = tracks.shapes(p), tracks.summaries(p)
    model = anomaly.fitted(shapes, epochs=20)
    path = str(tmp_path / "m.npz")
    sha = model.save(path)
    stored = anomaly.anomalies(shapes, made, model)
    dirty = spark.createDataFrame([("v1",), ("v5",)], "mmsi string")
    again = incremental.refreshed_anomalies(shapes, made, stored, dirty, path, sha)
    assert sorted(r["incident_id"] for r in again.collect()) == sorted(r["incident_id"] for r in stored.collect())
    with pytest.raises(ValueError):
        incremental.refreshed_anomalies(shapes, made, stored, dirty, path, "0" * 64)
    assert anomaly.fitted(shapes.limit(3)) is None and anomaly.anomalies(shapes, made, None).count() == 0
    points = [(k, str(5 + 0.01 * k), str(80 + 0.01 * k), None, "9") for k in range(12)]
    frame = lambda rows: spark.createDataFrame(rows, "at long, lat string, lon string, ts string, sog string")
    (r,) = anomaly.scored_points(frame(points), model).collect()
    assert r["problem"] is None and r["points_scored"] == 12 and r["reconstruction_error"] >= 0
    assert "6 points" in anomaly.scored_points(frame(points[:5]), model).first()["problem"]
    assert "place" in anomaly.scored_points(frame([*points, (12, "inf", "80", None, None)]), model).first()["problem"]
    assert "speed" in anomaly.scored_points(frame([*points, (12, "5", "80", None, "fast")]), model).first()["problem"]


@pytest.mark.parametrize("bad", [
    {"evidence": 1}, {"name": {"api_key": 1}}, {"name": "jdbc:postgresql://db/x"}, {"name": ["s3a://bucket/x"]}, {"name": "ftp://me:pw@host/"}, {"name": "spark.hadoop.fs.s3a.access.key=1"}, {"name": "see checkpoint/state"},
    {"name": "part-00000-11111111-2222-3333-4444-555555555555.parquet"}, {"name": "at /tmp/x"}, {"name": "at a.b.C.run(C.java:12)"}, {"name": 'File "x.py", line 3'}, {"name": "my word"}, {"value": float("nan")},
])
def test_private_things_are_refused(bad):
    with pytest.raises(ValueError):
        publish.checked(bad, secrets=("my word",))


def test_public_things_pass():
    good = {"name": "Gulf / lease, at sea (v1.2)", "lat": 1.23456, "score": 0.123456, "geometry": {"coordinates": [[103.12345, 1.0]]}, "zone": None}
    assert publish.checked(good, ("secret",)) == good | {"lat": 1.2346}
    with pytest.raises(TypeError):
        publish.checked({"name": {1, 2}})


def test_books_after_a_restart(spark):
    runs = spark.createDataFrame([("k", 0, 10, 9), ("k", 20, None, 25), ("k", 40, None, None)], "key string, started_us long, stopped_us long, last_message_us long")
    assert sorted((r["opened_us"], r["closed_us"]) for r in ledger.bridged(runs).collect()) == [(10, 20), (25, 40)]
    outs = spark.createDataFrame([("k", 20, 27, None), ("k", 0, 3, 4)], "key string, run_started_us long, opened_us long, closed_us long")
    closed, done = ledger.recovered(runs, outs)
    assert sorted((r["stopped_us"], r["status"]) for r in closed.collect()) == [(10, "stopped"), (25, "interrupted"), (40, "interrupted")]
    assert sorted((r["opened_us"], r["closed_us"]) for r in done.collect()) == [(3, 4), (27, 27)]
    assert [ledger.storage_level(x) for x in (1.9, 2, 5)] == ["normal", "warning", "hard"] and ledger.cadence_seconds("hard") == float("inf")


def test_files_are_filtered_and_digested(spark):
    raw = spark.createDataFrame([(" 1 ", "1.0", "2.0"), ("2", "1.0", "2.0"), ("1", "9", "2"), ("1", "x", "2")], "mmsi string, lat string, lon string")
    assert files.filtered(raw, 0, 0, 3, 3, ["1"]).count() == 1 and files.filtered(raw, 0, 0, 3, 3).count() == 2
    lines = spark.createDataFrame([("a",), ("b",)], "value string")
    assert files.digest(lines) == files.digest(lines.orderBy(F.desc("value"))) != files.digest(lines.limit(1))


def test_identities_come_from_the_first_file_by_name(spark, tmp_path):
    head = "MMSI,BaseDateTime,LAT,LON,VesselName"
    line = lambda m, k, name: f"{m},2024-01-01T00:{k // 60:02d}:{k % 60:02d},1.0,2.0,{name}"
    (tmp_path / "a.csv").write_text("\n".join([head, line("1", 0, "FIRST"), line("2", 0, "TWO")]))
    (tmp_path / "b.csv").write_text("\n".join([head, *[line("1", k, "LATER") for k in range(900)]]))  # larger, so read first
    got = {r["mmsi"]: r["name"] for r in files.vessels(files.report_csv(spark, str(tmp_path))).collect()}
    assert got == {"1": "FIRST", "2": "TWO"}
    plain = spark.createDataFrame([("3", "2024-01-01T00:00:00", "X"), ("3", "2024-01-01T00:00:01", "Y")], "mmsi string, basedatetime string, vesselname string").coalesce(1)
    assert files.vessels(plain).first()["name"] == "X"


def test_without_an_open_outage_there_is_no_category(spark):
    runs = spark.createDataFrame([("a", 0, None, 60_000_000)], "key string, started_us long, stopped_us long, last_message_us long")
    spans = spark.createDataFrame([("a", 0, 60_000_000)], "key string, start_us long, end_us long")
    book = lambda *rows: spark.createDataFrame(rows, "key string, opened_us long, closed_us long, reason string")
    said = lambda outages: feeds.status(runs, outages, spans, 120_000_000).first()
    assert said(book(("a", 1, 2, "websocket timeout")))["outage_category"] is None
    one = said(book(("a", 60_000_000, None, None)))
    assert one["outage_category"] == "coverage-unavailable" and one["outage_minutes"] == 1.0


def test_what_is_decided_needs_no_tracks(spark, monkeypatch):
    """Every event in observed time has a match or an unmatched row: the ids are the same without looking for tracks."""
    from tidewatch.operators import matching
    from tidewatch.plans import catalog, inputs, ledgers

    sf = "/root/testdata/sf0.001"
    told, p = ledgers.events(spark, sf), inputs.lens.positions(spark, sf)
    matches = matching.event_matches(labels.covered_events(told, ledgers.spans(spark, sf)), tracks.summaries(p))
    want = {r["event_id"] for r in labels.undecided(told, matches).collect()}
    monkeypatch.setattr(matching, "event_matches", lambda *_: pytest.fail("tracks were sought"))
    assert {r["event_id"] for r in catalog.queries()["undecided_events"](spark, sf).collect()} == want
