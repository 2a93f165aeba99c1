"""Every registered maritime query runs, and equals its SQL where it has one."""

import os

import pytest
from pyspark.sql import functions as F

from tidewatch.plans import catalog, feed_queries, inputs, ledgers

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no fixture tables")


def _plain(frame):
    return sorted(tuple(str(None if v is None or v != v else round(v, 9) if isinstance(v, float) else v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


WHOLE = ("incident_evidence", "vessel_threat_deterministic")  # these run the detectors themselves, the others read their written findings


@pytest.fixture(scope="session")
def findings(spark):
    return inputs.written(inputs.deterministic(spark, SF))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name, findings, monkeypatch):
    import duckdb

    if name not in WHOLE:
        for module in (catalog, feed_queries, ledgers):
            monkeypatch.setattr(module, "deterministic", lambda s, d: findings)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got, want = catalog.queries()[name](spark, SF).toPandas(), db.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert _plain(got) == _plain(want)


def test_shapes_are_gone_once_voyages_are_scored(spark, monkeypatch):
    from tidewatch.sources import shared

    held = lambda: [x for s in shared._scopes for x in s if shared.exists(spark, x)]
    before = []

    def detectors(p, outages):
        before.append(len(held()))
        return catalog.detect.spoofs(p)

    monkeypatch.setattr(catalog.detect, "all_incidents", detectors)
    with shared.scope(spark):
        found, errors, model = catalog._judged(spark, SF)
        assert before == [1] and len(held()) == 2  # errors, then findings too
        assert errors.where(F.col("error") > model.threshold).count() == found.where("detector = 'anomaly'").count() > 0


def test_fitted_models_agree_with_their_definition(spark):
    """Model queries against a direct computation on the driver: every voyage scored, the 99th percentile, what lies beyond."""
    import numpy as np

    from tidewatch.operators import anomaly, tracks, training
    from tidewatch.sources import lens

    made = tracks.shapes(lens.positions(spark, SF))
    shapes = made.toPandas().sort_values(["mmsi", "voyage"])
    x = np.array([[list(step) for step in v] for v in shapes["sequence"]], float)
    shards = {s: training.shard_of(own) for s, own in training.sharded(made).toPandas().groupby("shard")}
    model = training.descend(lambda f, *given: training.together({s: f(own, *given) for s, own in shards.items()}))
    errors = model.errors(x).round(12)
    want = {f"{m}" for m, e in zip(shapes["mmsi"] + "-" + (shapes["start_us"] // 1_000_000).astype(str), errors, strict=True) if e > np.percentile(errors, 99)}
    got = catalog.queries()["anomaly_incidents"](spark, SF).toPandas()
    assert {i.removeprefix("anomaly-") for i in got["incident_id"]} == want
    f = np.array([list(v) for v in shapes["features"]], float)
    both = catalog.queries()["anomaly_baselines"](spark, SF).toPandas().sort_values(["mmsi", "voyage"])
    mean, scale = f.mean(axis=0), f.std(axis=0) + 1e-6
    axes = np.linalg.svd((f - mean) / scale, full_matrices=False)[2][:8]
    assert np.allclose(both["pca_error"], anomaly.Components(mean, scale, axes).errors(f), atol=1e-9)
    assert np.allclose(both["forest_error"], training.forest(made).errors(f), atol=1e-9)


def test_shapes_and_lines_agree_with_plain_loops(spark):
    import numpy as np

    from tidewatch.operators import tracks
    from tidewatch.sources import lens

    v = tracks.voyages(lens.positions(spark, SF)).toPandas().sort_values(["mmsi", "us", "id"])
    shapes = {(r["mmsi"], r["voyage"]): r for r in catalog.queries()["track_shapes"](spark, SF).collect()}
    lines = {(r["mmsi"], r["voyage"]): r for r in catalog.queries()["polyline_simplify"](spark, SF).collect()}
    for key, g in v.groupby(["mmsi", "voyage"]):
        us, lat, lon, ids = (g[c].to_numpy() for c in ("us", "lat", "lon", "id"))
        assert (key in shapes) == (len(g) >= 6) and lines[key]["n_points"] == len(g)
        if key in shapes:
            moved = np.hypot(*np.diff(np.array(shapes[key]["features"][:-1]).reshape(-1, 2), axis=0).T)
            assert np.allclose(moved, [s[2] for s in shapes[key]["sequence"]], atol=3e-4)
        kept = lines[key]["kept"]
        assert kept[0] == ids[0] and kept[-1] == ids[-1] and set(kept) <= set(ids)
        at = [list(ids).index(i) for i in kept]
        x, y = lon * 111.19 * np.cos(np.radians(lat.mean())), lat * 111.19
        for a, b in zip(at, at[1:], strict=False):  # what is left out lies within the tolerance of the line that replaces it
            d = np.hypot(x[b] - x[a], y[b] - y[a])
            for k in range(a + 1, b):
                away = abs((x[b] - x[a]) * (y[k] - y[a]) - (y[b] - y[a]) * (x[k] - x[a])) / d if d else np.hypot(x[k] - x[a], y[k] - y[a])
                assert away <= 0.05 + 1e-9


def test_candidates_hold_every_meeting(spark):
    q = catalog.queries()
    near = {(r["a"], r["b"]) for r in q["near_moments"](spark, SF).collect()}
    assert near and near <= {(r["a"], r["b"]) for r in q["rendezvous_candidates"](spark, SF).collect()}


def test_readers_take_the_findings_of_all_detectors(spark, monkeypatch):
    rows = catalog._findings(spark, SF)
    found = rows.toPandas()
    assert set(found["detector"]) == {"gap", "spoof", "loiter", "rendezvous", "anomaly"} and found["incident_id"].is_unique
    readers = catalog._readers(lambda s, d: rows)
    assert {f"{name}_all" for name in readers} <= set(catalog.queries())
    got = {k: readers[k](spark, SF).toPandas() for k in ("stats_by_detector", "incident_topk", "detector_pr", "geoint_evidence", "pilot_figures")}
    assert dict(zip(got["stats_by_detector"]["detector"], got["stats_by_detector"]["incidents"], strict=True)) == found["detector"].value_counts().to_dict()
    assert dict(zip(got["stats_by_detector"]["detector"], got["stats_by_detector"]["vessels"], strict=True)) == found.groupby("detector")["mmsi"].nunique().to_dict()
    best = found.sort_values(["score", "incident_id"], ascending=[False, True])["incident_id"].head(50)
    assert got["incident_topk"]["incident_id"].tolist() == best.tolist()
    assert set(got["detector_pr"]["detector"]) == set(found["detector"]) and set(got["geoint_evidence"]["incident_id"]) == set(found["incident_id"])
    assert got["pilot_figures"]["alerts"].tolist() == [len(found)]
    monkeypatch.setattr(catalog, "_findings", lambda s, d: rows)
    fused = catalog.flagship(spark, SF).toPandas()
    assert set(fused["mmsi"]) == set(found["mmsi"]) and fused["n_incidents"].sum() == len(found)
    assert any("anomaly" in d.split(",") for d in fused["detectors"])
