"""Models fitted in the executors: the same for any partitioning, and equal to plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import anomaly, training, tracks

SCHEMA = "mmsi string, voyage long, start_us long, features array<double>, sequence array<array<double>>"


def _voyages(n=90, odd=6):
    rng = np.random.default_rng(0)
    x = np.stack([np.stack([np.ones(15), rng.normal(0, 0.1, 15), np.ones(15), rng.normal(0, 0.05, 15)], axis=1) for _ in range(n)])
    x[:odd, 5:, 3] += 2.0
    return x


@pytest.fixture(scope="module")
def shapes(spark):
    x = _voyages()
    return spark.createDataFrame([(f"{k:03d}", k % 3, k, v[:, :2].ravel().tolist(), v.tolist()) for k, v in enumerate(x)], SCHEMA)


def _plain(shapes, **settings):
    """The same descent over shards in one process."""
    shards = {s: training.shard_of(own) for s, own in training.sharded(shapes).toPandas().groupby("shard")}
    assert sum(len(t) + len(v) for t, v in shards.values()) == 90 and any(len(v) for _, v in shards.values())
    return training.descend(lambda f, *given: training.together({s: f(own, *given) for s, own in shards.items()}), **settings)


@pytest.fixture(scope="module")
def plain(shapes):
    return _plain(shapes, epochs=40)


@pytest.mark.parametrize("parts", [1, 7])
def test_any_partitioning_fits_the_same_model(shapes, plain, parts):
    model = training.fitted_in_tasks(shapes.repartition(parts), epochs=40)
    assert all((model.p[k] == plain.p[k]).all() for k in plain.p) and model.val_loss == plain.val_loss and (model.scale == plain.scale).all()


def test_every_voyage_is_fitted_on(shapes, monkeypatch):
    """More voyages than a sample once held, in batches of shards: each takes part, and in the same model as by plain loops."""
    made = shapes.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("mmsi", F.concat("mmsi", F.lit("-"), "copy")).drop("copy")
    seen, over_all = [], training.descend

    def noted(over, **settings):
        seen.append((over(training._counts)[:2].tolist(), settings["batches"]))
        return over_all(over, **settings)

    monkeypatch.setattr(training, "descend", noted)
    for name, value in (("SHARD_VOYAGES", 60), ("BATCH_SHARDS", 16), ("LOOK", 50)):
        monkeypatch.setattr(training, name, value)
    anomaly.fitted(made, epochs=1)
    ((steps, apart), batches), = seen
    assert steps / 15 + apart == 2_700 and batches == 2
    shards = {s: training.shard_of(own) for s, own in training.sharded(made, 45).toPandas().groupby("shard")}
    plain = over_all(lambda f, *given, batch=None: training.together({s: f(own, *given) for s, own in shards.items() if batch in (None, s % 2)}), epochs=6, batches=2)
    model = training.fitted_in_tasks(made.repartition(5), epochs=6)
    assert all(np.allclose(model.p[k], plain.p[k], atol=1e-6) for k in plain.p) and abs(model.val_loss - plain.val_loss) < 1e-6


def test_few_voyages_are_enough(shapes):
    assert training.fitted_in_tasks(shapes.where("mmsi < '003'"), epochs=3).parameters == 804


def test_the_model_finds_what_is_odd(shapes, plain):
    errors = plain.errors(_voyages())
    assert errors[:6].min() > np.percentile(errors[6:], 99)
    model = anomaly.fitted(shapes, epochs=40)
    assert abs(model.threshold - np.percentile(plain.errors(_voyages()).round(12), 99)) < 1e-9
    assert anomaly.fitted(shapes.limit(3)) is None


def test_a_forest_is_the_same_for_any_partitioning(shapes):
    x = _voyages().reshape(90, -1)
    a, b = (training.forest(shapes.repartition(n), "sequence", trees=30, size=32, seed=5) for n in (1, 6))
    assert a.trees == b.trees and len(a.trees) == 30 and a.size == 32
    errors = a.errors(x)
    assert errors[:6].mean() > errors[6:].mean() + 0.05

    def size(tree):
        return tree if isinstance(tree, int) else size(tree[2]) + size(tree[3])

    assert {size(t) for t in a.trees} == {32}


def test_components_equal_a_decomposition_of_all_rows(shapes):
    f = np.array([list(r["features"]) for r in shapes.orderBy("mmsi").collect()])
    made = training.components(shapes.repartition(5), "features", 4)
    mean, scale = f.mean(axis=0), f.std(axis=0) + 1e-6
    axes = np.linalg.svd((f - mean) / scale, full_matrices=False)[2][:4]
    want = anomaly.Components(mean, scale, axes)
    assert made.axes.shape == axes.shape and np.allclose(made.errors(f), want.errors(f), atol=1e-9)


def test_the_sweep_equals_a_loop(spark, shapes):
    labels = spark.createDataFrame([(f"{k:03d}", k % 3, k < 6) for k in range(90)], "mmsi string, voyage long, anomalous boolean")
    got = {r["hidden"]: r for r in training.capacity(shapes, labels, (3, 5), (0, 1), epochs=20).collect()}
    own = {r["mmsi"] for r in shapes.selectExpr("mmsi", "pmod(xxhash64(mmsi), 2) = 0 AS own").where("own").collect()}
    x, mine = _voyages(), np.array([f"{k:03d}" in own for k in range(90)])
    wrong = np.arange(90) < 6
    for h in (3, 5):
        cross, within = [], []
        for s in (0, 1):
            model = anomaly.SequenceModel(hidden=h, seed=s).fit(x[mine], 20)
            e = model.errors(x).round(9)
            pairs = lambda m: np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in e[m & wrong] for b in e[m & ~wrong]]) if (m & wrong).any() else np.nan
            within.append(pairs(mine))
            cross.append(pairs(~mine))
        r = got[h]
        assert r["runs"] == 2 and r["parameters"] == model.parameters
        known = pd.Series(cross).dropna()
        assert np.allclose([r["within_mean"], r["within_sd"]], [np.mean(within), np.std(within)]) and np.allclose([r["cross_mean"], r["cross_sd"], r["cross_min"]], [known.mean(), known.std(ddof=0), known.min()])


def test_rows_with_arrays_come_in_small_batches(spark):
    """Whatever a session had set, voyages reach a worker by the thousand; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    seen = lambda: max(r["n"] for r in spark.range(2_500).coalesce(1).mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n long").collect())
    p = spark.createDataFrame([], "id long, mmsi string, us long, lat double, lon double, sog double")
    for set_, most in (("10000", 1_000), ("0", 1_000), ("200", 200)):
        for made in (tracks.shapes, tracks.polylines):
            spark.conf.set(name, set_)
            made(p)
            assert seen() == most
    spark.conf.unset(name)
