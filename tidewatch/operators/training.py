"""Fitting the models of voyages in the executors: gradients, trees and moments are summed there, no voyage reaches the driver.

Voyages belong to shards by a hash of their key; how many there are hangs on the number of voyages alone, and sums are formed shard
by shard in their order. So the same seed gives the same sequence model for any number of tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.anomaly import MAX_TRAIN, MIN_VOYAGES, Components, Forest, SequenceModel
from tidewatch.sources.shared import written

SHARDS, SHARD_VOYAGES = 16, 2_048  # at least so many shards, and about so many voyages in one where there are more
BATCH_SHARDS, MOST_BATCHES = 32, 20  # of many shards about so many take part in a step, in turn; each voyage in every twentieth step at least
LOOK = 1_024  # voyages whose gradients are computed at once
HELD = 4  # one voyage of so many is kept apart
TREES, TREE_SAMPLE = 300, 256
Shard = tuple[np.ndarray, np.ndarray]
Over = Callable[..., np.ndarray]


def drawn(shapes: DataFrame, most: int | None = MAX_TRAIN) -> DataFrame:
    """About most voyages by a hash of their key; all of them where there are fewer, or without a bound."""
    n = shapes.count() if most else 0
    return shapes if not most or n <= most else shapes.where(F.pmod(F.xxhash64("mmsi", "voyage"), F.lit(1 << 30)) < int(most / n * (1 << 30)))


# -- the sequence model -----------------------------------------------------------------


def together(parts: dict[int, np.ndarray]) -> np.ndarray:
    """The sum of the shards' vectors in the order of shards."""
    return np.sum([parts[s] for s in sorted(parts)], axis=0)


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[2])


def _counts(shard: Shard) -> np.ndarray:
    train, apart = shard
    return np.append([len(_flat(train)), len(apart)], _flat(train).sum(axis=0, dtype=float))


def _squares(shard: Shard, mean: np.ndarray) -> np.ndarray:
    return ((_flat(shard[0]) - mean) ** 2).sum(axis=0)


def _some(x: np.ndarray, model: SequenceModel) -> Iterator[np.ndarray]:
    for k in range(0, len(x), LOOK):
        yield ((x[k : k + LOOK] - model.mean) / model.scale).astype(np.float32)


def _single(model: SequenceModel) -> SequenceModel:
    """The model in single precision, in which gradients are computed; their sums are double."""
    return SequenceModel(model.hidden, model.seed, {k: v.astype(np.float32) for k, v in model.p.items()}, model.mean, model.scale)


def _away(shard: Shard, model: SequenceModel) -> np.ndarray:
    """Summed squares and count of the steps kept apart in a shard."""
    model, apart = _single(model), shard[1]
    return np.array([sum(float(((model._run(x)[0] - x) ** 2).sum(dtype=float)) for x in _some(apart, model)), apart.size])


def _look(shard: Shard, model: SequenceModel, judged: bool = True) -> np.ndarray:
    """Summed squares and counts of both parts of a shard (the training one alone, unless judged), and the gradient of the training squares."""
    single, train, names = _single(model), shard[0], sorted(model.p)
    out = np.zeros(4 + model.parameters)
    out[1] = train.size
    if judged:
        out[2:4] = _away(shard, model)
    for x in _some(train, single):
        loss, g = single._gradients(x)
        out[0] += loss * x.size
        out[4:] += np.concatenate([np.ravel(g[k]) for k in names]).astype(float) * x.size
    return out


def descend(over: Over, hidden: int = 8, seed: int = 0, epochs: int = 300, rate: float = 5e-3, patience: int = 25, batches: int = 1) -> SequenceModel:
    """Adam on the mean loss of all training voyages; stops, and goes back to the best, when the voyages kept apart get no better.

    over(f, ...) returns f(shard, ...) of every shard, summed in the order of shards. With several batches a step takes over(f, ..., batch=k)
    of one of them, in turn, and all voyages kept apart are looked at after each round. epochs and patience count steps.
    """
    model = SequenceModel(hidden=hidden, seed=seed)
    sums = over(_counts)
    model.mean = sums[2:] / max(1, sums[0])
    spread = np.sqrt(over(_squares, model.mean) / max(1, sums[0]))
    model.scale = np.where(spread < 1e-6, 1.0, spread + 1e-6)
    model._start(len(model.mean))
    names = sorted(model.p)
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    best, kept, stale = np.inf, dict(model.p), 0
    for step in range(1, epochs + 2):
        seen = over(_look, model) if batches == 1 else over(_look, model, False, batch=(step - 1) % batches)
        ended = step > 1 and ((step - 1) % batches == 0 or step > epochs)
        if ended and batches > 1 and sums[1]:
            seen[2:4] = over(_away, model)
        if ended:
            now = seen[2] / seen[3] if sums[1] else seen[0] / max(1, seen[1])
            if now < best - 1e-6:
                best, kept, stale = float(now), {k: v.copy() for k, v in model.p.items()}, 0
            elif (stale := stale + batches) >= patience:
                break
        if step > epochs:
            break
        at = 4
        for k in names:
            g = seen[at : at + model.p[k].size].reshape(model.p[k].shape) / max(1, seen[1])
            at += model.p[k].size
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
            model.p[k] = model.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model.p, model.val_loss = kept, best
    return model


def shard_of(rows: pd.DataFrame) -> Shard:
    """(training, kept apart) steps of one shard's voyages, in the order of their keys."""
    rows = rows.sort_values(["mmsi", "voyage"])
    x, apart = np.array([[list(step) for step in v] for v in rows["x"]], np.float32), rows["apart"].to_numpy(bool)
    return x[~apart], x[apart]


def sharded(shapes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(shard, apart, mmsi, voyage, x) of voyages; x in single precision."""
    key = lambda word, n: F.pmod(F.xxhash64("mmsi", "voyage", F.lit(word)), F.lit(n))
    return shapes.select(key("shard", shards).cast("int").alias("shard"), (key("apart", HELD) == 0).alias("apart"), "mmsi", "voyage", F.col("sequence").cast("array<array<float>>").alias("x"))


def fitted_in_tasks(shapes: DataFrame, **settings) -> SequenceModel:
    """The model of descend() over all shapes. Shards are packed once and written, batch after batch; each step is a small job that sums
    the shards' gradients, of which the driver sees one vector a shard. Executors that are lost read their shards again."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "packed": [pickle.dumps(shard_of(rows))]})

    spark = shapes.sparkSession
    n = max(SHARDS, -(-shapes.count() // SHARD_VOYAGES))
    batches = max(1, min(MOST_BATCHES, n // BATCH_SHARDS))
    every, held = sharded(shapes, n), []
    for k in range(batches):
        own = every.where(F.col("shard") % batches == k).repartition(min(BATCH_SHARDS, -(-n // batches)), "shard")
        packed = written(own.groupBy("shard").applyInPandas(pack, "shard int, packed binary"))
        held.append(packed.rdd.map(lambda r: (r["shard"], pickle.loads(r["packed"]))).persist(StorageLevel.MEMORY_AND_DISK))  # iterated, so kept in the workers' form
    whole = held[0] if batches == 1 else spark.sparkContext.union(held)

    def over(f: Callable[..., np.ndarray], *given, batch: int | None = None) -> np.ndarray:
        shards = whole if batch is None else held[batch]
        return together(dict(shards.map(lambda s: (s[0], f(s[1], *given))).collect()))

    try:
        return descend(over, batches=batches, **settings)
    finally:
        for shards in held:
            shards.unpersist()


# -- baselines --------------------------------------------------------------------------


def forest(shapes: DataFrame, column: str = "features", trees: int = TREES, size: int = TREE_SAMPLE, seed: int = 0) -> Forest:
    """An isolation forest, one tree a group: each tree takes the size voyages with the least hashes of their key and its number.

    A threshold on the hashes lets about four times as many voyages through as a tree needs."""
    n = shapes.count()
    most = int(min(1.0, 4 * size / max(1, n)) * (1 << 30))
    draw = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.pmod(F.xxhash64("mmsi", "voyage", t, F.lit(seed)), F.lit(1 << 30)).alias("h"))), lambda d: d["h"] < most)
    rows = shapes.select("mmsi", "voyage", F.col(column).alias("x"), F.explode(draw).alias("d")).select("mmsi", "voyage", "x", "d.tree", "d.h")

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values(["h", "mmsi", "voyage"]).head(size)
        x = np.array([np.ravel([list(s) if hasattr(s, "__len__") else s for s in v]) for v in own["x"]], float)
        number = int(rows["tree"].iloc[0])
        made = Forest.grow(x, np.random.default_rng([seed, number]), int(np.ceil(np.log2(max(2, min(size, n))))))
        return pd.DataFrame({"tree": [number], "made": [pickle.dumps(made)]})

    grown = rows.groupBy("tree").applyInPandas(grow, "tree int, made binary").collect()  # a tree has at most twice size nodes
    return Forest([pickle.loads(r["made"]) for r in sorted(grown, key=lambda r: r["tree"])], min(size, n))


def components(shapes: DataFrame, column: str = "features", k: int = 8) -> Components:
    """Principal components of standardised features from summed moments: means first, then centred products."""
    width = shapes.select(F.size(column).alias("n")).first()["n"]
    n = shapes.count()

    def summed(of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(size)
            for batch in batches:
                if len(batch):
                    total += of(np.array([list(v) for v in batch["x"]], float))
            yield pd.DataFrame({"cell": np.arange(size), "total": total})

        rows = shapes.select(F.col(column).alias("x")).mapInPandas(run, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
        out = np.zeros(size)
        for r in rows:
            out[r["cell"]] = r["total"]
        return out

    mean = summed(lambda x: x.sum(axis=0), width) / n
    moments = summed(lambda x: ((x - mean).T @ (x - mean)).ravel(), width * width).reshape(width, width) / n
    scale = np.sqrt(np.diag(moments)) + 1e-6
    _, axes = np.linalg.eigh(moments / np.outer(scale, scale))
    return Components(mean, scale, axes.T[::-1][: min(k, width, n - 1)])


# -- capacity ---------------------------------------------------------------------------


def auc(score: np.ndarray, positive: np.ndarray) -> float:
    """ROC AUC of a bounded sample by ranks, ties half; NaN where a class is empty."""
    values, which, many = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(many) - (many - 1) / 2)[which]
    p, n = int(positive.sum()), int((~positive).sum())
    return float((rank[positive].sum() - p * (p + 1) / 2) / (p * n)) if p and n else float("nan")


def capacity(shapes: DataFrame, labels: DataFrame, hidden: tuple[int, ...] = (8, 16, 32, 64), seeds: tuple[int, ...] = (0, 1, 2, 3, 4), most: int = MAX_TRAIN, epochs: int = 300) -> DataFrame:
    """hidden, parameters, runs, within and cross mean and spread, least cross: how well models of each size tell labelled voyages.

    labels are (mmsi, voyage, anomalous). Models are trained without labels on one half of the vessels and judged on it
    and on the other half. A sample of about most voyages is broadcast; each task trains one size with one seed.
    """
    spark = shapes.sparkSession
    rows = drawn(shapes.join(labels.select("mmsi", "voyage", "anomalous"), ["mmsi", "voyage"]), most).select("mmsi", "voyage", "anomalous", (F.pmod(F.xxhash64("mmsi"), F.lit(2)) == 0).alias("own"), F.col("sequence").alias("x")).toPandas().sort_values(["mmsi", "voyage"])
    x = np.array([[list(step) for step in v] for v in rows["x"]], float)
    sample = spark.sparkContext.broadcast((x, rows["own"].to_numpy(bool), rows["anomalous"].to_numpy(bool)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, own, wrong = sample.value
        for batch in batches:
            made = []
            for h, s in zip(batch["hidden"].tolist(), batch["seed"].tolist(), strict=True):
                if own.sum() < MIN_VOYAGES:
                    continue
                model = SequenceModel(hidden=h, seed=s).fit(x[own], epochs)
                errors = model.errors(x).round(9)
                made.append((h, s, model.parameters, auc(errors[own], wrong[own]), auc(errors[~own], wrong[~own])))
            yield pd.DataFrame(made, columns=["hidden", "seed", "parameters", "within", "cross"])

    grid = spark.createDataFrame([(h, s) for h in hidden for s in seeds], "hidden int, seed int").repartition(len(hidden) * len(seeds), "hidden", "seed")
    runs = grid.mapInPandas(run, "hidden int, seed int, parameters int, within double, cross double")
    known = {c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("within", "cross")}
    return runs.withColumns(known).groupBy("hidden").agg(
        F.max("parameters").alias("parameters"), F.count("*").alias("runs"), *[f(c).alias(f"{c}_{n}") for c in ("within", "cross") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))], F.min("cross").alias("cross_min"),
    )
