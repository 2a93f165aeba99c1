"""Unusual trajectories: a recurrent autoencoder over voyage steps, with PCA and isolation forest as baselines.

Models are fitted in the executors on all voyages and broadcast; all voyages are
scored inside the executors, batch by batch, and the threshold comes from all scores.
"""

from __future__ import annotations

import hashlib
import io
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.grading import anomaly_score
from tidewatch.operators.detect import incidents
from tidewatch.operators.ordered import quantiles
from tidewatch.sources.shared import small_batches

MAX_TRAIN = 2_000
MIN_VOYAGES = 4  # fewer can't fit a model


def _gate(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Cell:
    """A gated recurrent cell; forward keeps what backward needs."""

    def __init__(self, p: dict, name: str):
        self.w, self.u, self.b, self.c = (p[f"{name}_{k}"] for k in "wubc")
        self.name, self.trail = name, []

    def forward(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        n = h.shape[1]
        a, r = x @ self.w + self.b, h @ self.u + self.c
        z, reset = _gate(a[:, :n] + r[:, :n]), _gate(a[:, n : 2 * n] + r[:, n : 2 * n])
        new = np.tanh(a[:, 2 * n :] + reset * r[:, 2 * n :])
        self.trail.append((x, h, z, reset, new, r[:, 2 * n :]))
        return (1 - z) * new + z * h

    def backward(self, dh: np.ndarray, g: dict) -> tuple[np.ndarray, np.ndarray]:
        x, h, z, reset, new, rn = self.trail.pop()
        dnew = dh * (1 - z) * (1 - new * new)
        dz = dh * (h - new) * z * (1 - z)
        dreset = dnew * rn * reset * (1 - reset)
        da, dr = np.concatenate([dz, dreset, dnew], axis=1), np.concatenate([dz, dreset, dnew * reset], axis=1)
        for k, v in (("w", x.T @ da), ("u", h.T @ dr), ("b", da.sum(axis=0)), ("c", dr.sum(axis=0))):
            g[f"{self.name}_{k}"] = g.get(f"{self.name}_{k}", 0) + v
        return da @ self.w.T, dh * z + dr @ self.u.T


@dataclass
class SequenceModel:
    """Encoder, repeated last state, decoder and a linear output; errors are mean squares of standardised steps."""

    hidden: int = 8
    seed: int = 0
    p: dict = field(default_factory=dict)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    threshold: float = float("nan")
    val_loss: float = float("nan")

    def _start(self, channels: int) -> None:
        rng, h = np.random.default_rng(self.seed), self.hidden
        draw = lambda *shape: rng.uniform(-1, 1, shape) / np.sqrt(h)
        self.p = {"e_w": draw(channels, 3 * h), "e_u": draw(h, 3 * h), "e_b": draw(3 * h), "e_c": draw(3 * h), "d_w": draw(h, 3 * h), "d_u": draw(h, 3 * h), "d_b": draw(3 * h), "d_c": draw(3 * h), "o_w": draw(h, channels), "o_b": draw(channels)}

    @property
    def parameters(self) -> int:
        return sum(v.size for v in self.p.values())

    def _run(self, x: np.ndarray):
        encoder, decoder = Cell(self.p, "e"), Cell(self.p, "d")
        h = np.zeros((len(x), self.hidden), x.dtype)
        for k in range(x.shape[1]):
            h = encoder.forward(x[:, k], h)
        code, states, s = h, [], np.zeros_like(h)
        for _ in range(x.shape[1]):
            s = decoder.forward(code, s)
            states.append(s)
        return np.stack([s @ self.p["o_w"] + self.p["o_b"] for s in states], axis=1), (encoder, decoder, states)

    def _gradients(self, x: np.ndarray) -> tuple[float, dict]:
        out, (encoder, decoder, states) = self._run(x)
        d = 2 * (out - x) / x.size
        g: dict = {"o_w": sum(s.T @ d[:, k] for k, s in enumerate(states)), "o_b": d.sum(axis=(0, 1))}
        ds, dcode = np.zeros_like(states[0]), np.zeros_like(states[0])
        for k in reversed(range(x.shape[1])):
            dx, ds = decoder.backward(ds + d[:, k] @ self.p["o_w"].T, g)
            dcode += dx
        for _ in range(x.shape[1]):
            _, dcode = encoder.backward(dcode, g)
        return float(((out - x) ** 2).mean()), g

    def fit(self, x: np.ndarray, epochs: int = 300, rate: float = 5e-3, patience: int = 25) -> SequenceModel:
        """Adam on all training voyages at once; stops and goes back when a quarter kept apart gets no better."""
        order = np.random.default_rng(self.seed).permutation(len(x))
        held = order[: len(x) // 4]
        train = x[order[len(x) // 4 :]]
        self.mean, spread = train.mean(axis=(0, 1)), train.std(axis=(0, 1))
        self.scale = np.where(spread < 1e-6, 1.0, spread)
        self._start(x.shape[2])
        train, val = (train - self.mean) / self.scale, (x[held] - self.mean) / self.scale
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        best, kept, stale = np.inf, dict(self.p), 0
        for step in range(1, epochs + 1):
            loss, g = self._gradients(train)
            for k, v in g.items():
                first[k], second[k] = 0.9 * first[k] + 0.1 * v, 0.999 * second[k] + 0.001 * v * v
                self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            now = float(((self._run(val)[0] - val) ** 2).mean()) if len(val) else loss
            if now < best - 1e-6:
                best, kept, stale = now, {k: v.copy() for k, v in self.p.items()}, 0
            elif (stale := stale + 1) >= patience:
                break
        self.p, self.val_loss = kept, best
        return self

    def errors(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return ((self._run(z)[0] - z) ** 2).mean(axis=(1, 2))

    def calibrate(self, x: np.ndarray, percentile: float = 99.0) -> SequenceModel:
        self.threshold = float(np.percentile(self.errors(x), percentile))
        return self

    def save(self, path: str) -> str:
        """Writes the model in one step, next to its place first, and returns its SHA-256."""
        buffer = io.BytesIO()
        np.savez(buffer, version=1, hidden=self.hidden, mean=self.mean, scale=self.scale, threshold=self.threshold, val_loss=self.val_loss, **{f"p_{k}": v for k, v in self.p.items()})
        with open(f"{path}.tmp", "wb") as f:
            f.write(buffer.getvalue())
        os.replace(f"{path}.tmp", path)
        return hashlib.sha256(buffer.getvalue()).hexdigest()

    @classmethod
    def load(cls, path: str, sha256: str | None = None) -> SequenceModel:
        with open(path, "rb") as f:
            data = f.read()
        if sha256 and hashlib.sha256(data).hexdigest() != sha256:
            raise ValueError("the model file isn't the one that was frozen")
        z = np.load(io.BytesIO(data))
        return cls(int(z["hidden"]), 0, {k[2:]: z[k] for k in z.files if k.startswith("p_")}, z["mean"], z["scale"], float(z["threshold"]), float(z["val_loss"]))


@dataclass
class Components:
    """Reconstruction error from the leading principal components of standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    axes: np.ndarray

    def errors(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return ((z - z @ self.axes.T @ self.axes) ** 2).mean(axis=1)


@dataclass
class Forest:
    """Isolation by random splits; the score is higher where few splits are needed."""

    trees: list
    size: int

    @classmethod
    def grow(cls, x: np.ndarray, rng, depth: int):
        """A tree over the rows of x: their number, or (column, threshold, left, right)."""
        if depth == 0 or len(x) <= 1:
            return len(x)
        low, high = x.min(axis=0), x.max(axis=0)
        wide = np.flatnonzero(high > low)
        if not len(wide):
            return len(x)
        c = int(rng.choice(wide))
        at = rng.uniform(low[c], high[c])
        return c, at, cls.grow(x[x[:, c] < at], rng, depth - 1), cls.grow(x[x[:, c] >= at], rng, depth - 1)

    @staticmethod
    def _rest(n: int) -> float:
        return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def errors(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            stack = [(tree, np.arange(len(x)), 0)]
            while stack:
                node, rows, depth = stack.pop()
                if isinstance(node, int):
                    total[rows] += depth + self._rest(node)
                elif len(rows):
                    left = x[rows, node[0]] < node[1]
                    stack += [(node[2], rows[left], depth + 1), (node[3], rows[~left], depth + 1)]
        return 2 ** (-total / len(self.trees) / max(1e-9, self._rest(self.size)))


def fitted(shapes: DataFrame, epochs: int = 300) -> SequenceModel | None:
    """A model fitted in the executors on all voyages, its threshold from the errors of all; none where there are fewer than MIN_VOYAGES."""
    from tidewatch.operators import training

    if shapes.limit(MIN_VOYAGES).count() < MIN_VOYAGES:
        return None
    return calibrated(shapes, training.fitted_in_tasks(shapes, epochs=epochs))


def scored(shapes: DataFrame, model, column: str = "sequence") -> DataFrame:
    """(mmsi, voyage, start_us, error) of every voyage; rounded, so that the size of a batch doesn't show."""
    small_batches(shapes.sparkSession)
    sent = shapes.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([[list(step) for step in v] if column == "sequence" else list(v) for v in batch["x"]], float)
            yield batch[["mmsi", "voyage", "start_us"]].assign(error=sent.value.errors(x).round(12) if len(x) else np.zeros(0))

    return shapes.select("mmsi", "voyage", "start_us", F.col(column).alias("x")).mapInPandas(run, "mmsi string, voyage long, start_us long, error double")


def calibrated(shapes: DataFrame, model: SequenceModel, percentile: float = 99.0) -> SequenceModel:
    """The model with its threshold at that percentile of the errors of all voyages, fitted on or not."""
    model.threshold = float(quantiles(scored(shapes, model), "error", {"q": percentile / 100}).first()["q"])
    return model


def errors_of(shapes: DataFrame, model: SequenceModel | None) -> DataFrame:
    """scored(), without rows where there is no model."""
    return scored(shapes, model) if model else shapes.where(F.lit(False)).select("mmsi", "voyage", "start_us", F.lit(0.0).alias("error"))


def anomalies(shapes: DataFrame, tracks: DataFrame, model: SequenceModel | None) -> DataFrame:
    """Incidents of voyages whose error exceeds the model's threshold, placed where they start; none without a model."""
    return unusual(errors_of(shapes, model), tracks, model)


def unusual(errors: DataFrame, tracks: DataFrame, model: SequenceModel | None) -> DataFrame:
    """anomalies() from the errors of voyages."""
    model = model or SequenceModel(threshold=0.0)
    rows = errors.where(F.col("error") > model.threshold).join(tracks.select("mmsi", "voyage", "end_us", F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon"), "region"), ["mmsi", "voyage"])
    rows = rows.withColumns({"score": anomaly_score(F.col("error"), F.lit(model.threshold)), "confidence": F.lit(0.45), "ts_start_us": F.col("start_us"), "ts_end_us": F.col("end_us"), "minutes": F.lit(None).cast("double"), "km": F.lit(None).cast("double"), "knots": F.lit(None).cast("double")})
    held = {"reconstruction_error": F.round("error", 5), "threshold": F.round(F.lit(model.threshold), 5), "caveat": F.lit("unusual isn't unlawful")}
    return incidents(rows, "anomaly", F.lit("trajectory anomaly"), F.array(F.lit("trajectory-anomaly"), F.lit("pattern-of-life-deviation")), evidence=held)


def scored_points(points: DataFrame, model: SequenceModel, least: int = 6) -> DataFrame:
    """One row on the one track that the points (lat, lon, ts, sog; all text) are: its score, or what is wrong with them.

    A time may be seconds since 1970 or an ISO form; points without one stand five minutes apart, in the order of at.
    """
    from tidewatch.functions import parsing
    from tidewatch.operators import tracks

    lat, lon = parsing.coordinate(parsing.number(F.col("lat")), -90, 90), parsing.coordinate(parsing.number(F.col("lon")), -180, 180)
    seconds = F.coalesce(parsing.number(F.col("ts")), F.unix_micros(F.try_to_timestamp(F.regexp_replace("ts", "Z$", "+00:00"))) / F.lit(1e6), F.col("at") * 300.0)
    rows = points.select(F.lit("query").alias("mmsi"), F.col("at").cast("long").alias("id"), (seconds * 1e6).cast("long").alias("us"), lat.alias("lat"), lon.alias("lon"), parsing.coordinate(parsing.number(F.col("sog")), -1e6, 1e6).alias("sog"), F.lit("query").alias("region"), F.col("sog").isNotNull().alias("has_sog"))
    state = rows.agg(F.count("*").alias("n"), F.sum((F.col("lat").isNull() | F.col("lon").isNull()).cast("int")).alias("bad"), F.sum((F.col("has_sog") & F.col("sog").isNull()).cast("int")).alias("bad_sog"))
    error = F.when(F.col("n") < least, f"need at least {least} points").when(F.col("bad") > 0, "a point lacks a finite place").when(F.col("bad_sog") > 0, "a point's speed is no number")
    whole = rows.where("lat IS NOT NULL AND lon IS NOT NULL")
    result = scored(tracks.shapes(whole, min_points=least, gap_minutes=1 << 30), model).select("error")
    one = state.select("n", error.alias("problem")).crossJoin(result.withColumnRenamed("error", "raw").agg(F.max("raw").alias("raw")))  # single rows
    ok = lambda c: F.when(F.col("problem").isNull(), c)
    return one.select("problem", ok(F.round(anomaly_score(F.col("raw"), F.lit(model.threshold)), 4)).alias("anomaly_score"), ok(F.round("raw", 6)).alias("reconstruction_error"), ok(F.col("raw") > model.threshold).alias("is_anomalous"), F.col("n").alias("points_scored"))
