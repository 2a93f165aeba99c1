"""Document quality by a factorisation machine.

A document becomes hashed words (length-normalised counts), statistics of its structure
and its size as metadata. Besides a weight each feature has a short vector; the score adds
the inner products of all pairs of vectors, computed in linear time as half of the square
of the sum less the sum of squares. The machine is fitted in numpy on a bounded sample of
labelled rows; scoring runs over all rows inside the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tidewatch.llm.fitting import MAX_BYTES, remainder, sample
from tidewatch.llm.tables import table
from tidewatch.llm.text import Words, chunks, flat, mix

BITS = 14
FACTORS = 6
MAX_TRAIN = 6_000
EPOCHS = 8
THRESHOLD = 0.3
STATS = 20
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_UPPER, _DIGIT, _LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, row starts) of some texts; every row has its STATS statistics, words or not."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    first, count = words.offsets[:-1], np.diff(words.offsets)
    row = np.repeat(np.arange(n), count)
    bucket = (words.hash >> np.uint64(64 - BITS)).astype(np.int64)
    key, times = np.unique((row << BITS) | bucket, return_counts=True)
    owner, index = key >> BITS, key & ((1 << BITS) - 1)
    norm = np.sqrt(np.bincount(owner, times.astype(float) ** 2, minlength=n))
    value = times / np.maximum(norm[owner], 1e-9)

    sums = lambda flags: _sums(flags, offsets)
    of_words = lambda flags: np.bincount(row, flags, minlength=n) / np.maximum(count, 1)
    size, some = np.diff(offsets), np.maximum(np.diff(offsets), 1)
    end, width = words.end, words.end - words.start
    last = _PUNCT[data[end - 1]] if len(end) else np.zeros(0, bool)
    two = last & (width > 1) & _PUNCT[data[np.maximum(end - 2, 0)]] if len(end) else last
    three = two & (width > 2) & _PUNCT[data[np.maximum(end - 3, 0)]] if len(end) else last
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    caps = (upper[end] - upper[words.start] == letters[end] - letters[words.start]) & (letters[end] - letters[words.start] > 1)
    bare = letters[end] == letters[words.start]
    again = np.zeros(len(row), bool)
    if len(row) > 2:
        h = words.hash
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        again[2:] |= (h[2:] == h[:-2]) & (row[2:] == row[:-2])
    pair = mix(words.hash[1:] + np.uint64(3) * words.hash[:-1]) if len(row) > 1 else np.zeros(0, np.uint64)
    inside = row[1:] == row[:-1] if len(row) > 1 else np.zeros(0, bool)
    pairs = np.bincount(row[1:][inside], minlength=n) if len(row) > 1 else np.zeros(n)
    own = np.unique(mix(pair[inside] ^ (row[1:][inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1] if inside.any() else np.zeros(0, int)
    distinct = np.bincount(row[1:][inside][own], minlength=n) if inside.any() else np.zeros(n)
    kinds = np.bincount(owner, minlength=n)
    lines = sums(data == 10)
    stats = np.stack([
        np.log1p(size), np.log1p(count), np.log1p(lines), size / np.maximum(count, 1) / 10, count / (lines + 1) / 50, sums(_UPPER[data]) / some * 4, sums(_DIGIT[data]) / some * 10, sums(_PUNCT[data]) / some * 4,
        sums(data >= 128) / some * 4, of_words(last), of_words(two), of_words(three), of_words(caps), of_words(bare), of_words(again), of_words(width > 20),
        1 - distinct / np.maximum(pairs, 1), kinds / np.maximum(count, 1), np.sqrt(of_words(two)), np.sqrt(of_words(bare | caps)),
    ], axis=1)
    index = np.concatenate([index, np.tile((1 << BITS) + np.arange(STATS), n)])
    value = np.concatenate([value, stats.ravel()])
    order = np.argsort(np.concatenate([owner, np.repeat(np.arange(n), STATS)]), kind="stable")
    starts = np.concatenate([[0], np.cumsum(kinds + STATS)])
    return index[order].astype(np.int32), value[order].astype(np.float32), starts


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


class Machine:
    """A fitted factorisation machine."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        size = (1 << BITS) + STATS
        self.mean, self.scale = mean.astype(np.float32), scale.astype(np.float32)
        self.bias = 0.0
        self.w = np.zeros(size, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, FACTORS)).astype(np.float32)

    def _standard(self, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        k = index - (1 << BITS)
        dense = k >= 0
        out = value.copy()
        out[dense] = np.clip((value[dense] - self.mean[k[dense]]) / self.scale[k[dense]], -6, 6) / 2
        return out

    def parts(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray):
        x = self._standard(index, value)
        rows = self.v[index] * x[:, None]
        total = np.add.reduceat(rows, starts[:-1], axis=0)
        squares = np.add.reduceat((rows * rows).sum(axis=1), starts[:-1])
        linear = np.add.reduceat(self.w[index] * x, starts[:-1])
        return x, rows, total, self.bias + linear + 0.5 * ((total * total).sum(axis=1) - squares)

    def score(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if len(starts) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.parts(index, value, starts)[3].astype(float), -30, 30)))


def fit(index: np.ndarray, value: np.ndarray, starts: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss with a little weight decay."""
    n = len(y)
    dense = index >= (1 << BITS)
    stats = value[dense].reshape(n, STATS) if n else np.zeros((1, STATS))
    m = Machine(stats.mean(axis=0), stats.std(axis=0) + 1e-3, seed)
    if not n or y.min() == y.max():
        m.bias = 0.0 if not n else 4.0 * (2 * float(y[0]) - 1)
        return m
    rate = float(np.clip(y.mean(), 0.01, 0.99))
    m.bias = float(np.log(rate / (1 - rate)))
    gw, gv = np.full_like(m.w, 1e-2), np.full_like(m.v, 1e-2)
    rng = np.random.default_rng(seed)
    width = np.diff(starts)
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, 64):
            rows = order[k : k + 64]
            many = width[rows]
            begin = np.concatenate([[0], np.cumsum(many)])
            at = np.repeat(starts[rows] - begin[:-1], many) + np.arange(begin[-1])
            idx, val = index[at], value[at]
            x, parts, total, z = m.parts(idx, val, begin)
            err = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y[rows]).astype(np.float32) / len(rows)
            each = np.repeat(err, many)
            dw = np.bincount(idx, each * x, minlength=len(m.w)).astype(np.float32) + 1e-5 * m.w
            dv_rows = each[:, None] * x[:, None] * (np.repeat(total, many, axis=0) - parts)
            dv = np.stack([np.bincount(idx, dv_rows[:, f], minlength=len(m.w)) for f in range(FACTORS)], axis=1).astype(np.float32) + 1e-4 * m.v
            gw += dw * dw
            gv += dv * dv
            m.w -= 0.1 * dw / np.sqrt(gw)
            m.v -= 0.05 * dv / np.sqrt(gv)
            m.bias -= 0.1 * float(err.sum())
    return m


def _chunked(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = flat(column)
    for i, j in chunks(offsets):
        yield features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def train(docs: DataFrame, labels: DataFrame, usable, label: str = "quality", most: int = MAX_TRAIN, most_bytes: int = MAX_BYTES) -> Machine:
    """Fits on about most labelled documents for which usable holds, of most_bytes at most; features are made by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for index, value, starts in _chunked(batch["text"]):
                out += [(index[a:b].tobytes(), value[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["doc_id", "y", "i", "x"])

    rows = sample(docs, labels, label, usable, most, most_bytes).mapInArrow(run, "doc_id long, y int, i binary, x binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    index, value = np.frombuffer(b"".join(r["i"] for r in rows), np.int32), np.frombuffer(b"".join(r["x"] for r in rows), np.float32)
    return fit(index, value, np.concatenate([[0], np.cumsum([len(r["i"]) // 4 for r in rows])]).astype(np.int64), np.array([r["y"] for r in rows], np.float32))


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs, score (0 to 1, higher: better) and predicted (1 from threshold on).

    A null or empty text is scored by its statistics alone. Rows are scored one by one, so
    repeated rows agree; columns that clash with the results are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    schema = StructType([f for f in docs.schema.fields if f.name not in ("score", "predicted")] + [StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([np.zeros(0), *(sent.value.score(*x) for x in _chunked(batch["text"]))])
            columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names) if n not in ("score", "predicted")}
            columns |= {"score": pa.array(found, pa.float64()), "predicted": pa.array((found >= threshold).astype(np.int32))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return score(docs, machine).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
