"""Whitening of embeddings by a compensated covariance and a divide-and-conquer eigen-solve.

Entries become integers. Over the distinct vectors, every task adds up centred outer products
in double-double: blocks of centred rows are cut into slices of few bits, so that each product
of two slices is exact in doubles (an error-free transformation of the matrix product), and
exact products are added with two-sums that keep the rounding errors. Tasks hand on high and low parts,
which are merged as a tree by further tasks. Only the finished matrix, its size fixed by the
dimension, reaches the driver, which reduces it to a tridiagonal one, solves that by divide
and conquer (secular equations with recomputed weights) and corrects the leading vectors once by their
residuals against high and low parts together.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import cut, table

SCALE = 256
COMPONENTS = 4
LARGEST = 1 << 40  # of an entry's size, so that sums and squares stay exact
BLOCK = 1_024  # rows of one product
BITS = 20  # of a slice: 2 * BITS + log2(BLOCK) < 53
SLICES = 5
FAN_IN = 32
_EPS = np.finfo(float).eps
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# double-double ---------------------------------------------------------------------------


def two_sum(a, b):
    """a + b rounded, and the rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def quick_two_sum(a, b):
    """The same where a is the larger."""
    s = a + b
    return s, b - (s - a)


def add(a: tuple, b: tuple) -> tuple:
    """The sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = quick_two_sum(s, e + t)
    return quick_two_sum(s, e + f)


def centred(x: np.ndarray, mean: tuple) -> tuple:
    """x - mean as a double-double; x holds integers below 2^53."""
    s, e = two_sum(x.astype(float), -mean[0])
    return quick_two_sum(s, e - mean[1])


def slices(a: tuple) -> list[np.ndarray]:
    """Double-double columns as a sum of matrices, each of BITS bits relative to its column's unit."""
    high, low = a
    top = np.max(np.abs(high), axis=0)
    unit = np.where(top > 0, np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1))) + 1 - BITS), 1.0)
    out = []
    for _ in range(SLICES):
        q = np.rint(high / unit) * unit
        out.append(q)
        high, low = quick_two_sum(high - q, low)
        unit = unit * 2.0**-BITS
    return out


def outer_products(d: tuple) -> tuple:
    """The sum of the rows' outer products, as a double-double matrix."""
    total = (np.zeros((d[0].shape[1],) * 2), np.zeros((d[0].shape[1],) * 2))
    for at in range(0, len(d[0]), BLOCK):
        parts = slices((d[0][at : at + BLOCK], d[1][at : at + BLOCK]))
        for k, a in enumerate(parts):
            for j in range(k, SLICES - k):
                exact = a.T @ parts[j]
                total = add(total, (exact, np.zeros_like(exact)))
                if j > k:
                    total = add(total, (exact.T, np.zeros_like(exact)))
    return total


# eigen-solve -----------------------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d, e, q) with q.T a q tridiagonal, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(d) + rho z z^T for ascending distinct d, nonzero z and rho > 0.

    Each root is held as its distance from the nearer pole, found by bisection on a
    logarithmic scale; the weights are then recomputed from the roots, which keeps the
    vectors orthogonal.
    """
    k = len(d)
    gap = np.append(np.diff(d), rho * (z @ z))
    weight = rho * z * z
    with np.errstate(divide="ignore", invalid="ignore"):
        middle = 1 + (weight / (d - (d + gap / 2)[:, None])).sum(1)
    left = (middle >= 0) | (np.arange(k) == k - 1)
    origin = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    delta, sign = d[None, :] - d[origin][:, None], np.where(left, 1.0, -1.0)
    most = np.where(np.arange(k) == k - 1, gap, gap / 2)
    low, high = np.log(most) - 110, np.log(most) + 1e-12
    for _ in range(70):
        t = (low + high) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            f = 1 + (weight / (delta - (sign * np.exp(t))[:, None])).sum(1)
        outward = np.where(left, f < 0, f > 0)  # f rises from pole to pole, so the root lies farther from its pole
        low, high = np.where(outward, t, low), np.where(outward, high, t)
    shift = sign * np.exp((low + high) / 2)
    away = shift[:, None] - delta  # root i less pole j
    new = np.empty(k)
    for j in range(k):
        below, above = np.arange(j), np.arange(j, k - 1)
        new[j] = np.sqrt(np.abs(away[k - 1, j] / rho * np.prod(away[below, j] / (d[below] - d[j])) * np.prod(away[above, j] / (d[above + 1] - d[j]))))
    u = np.copysign(new, z)[:, None] / -away.T
    return d[origin] + shift, u / np.linalg.norm(u, axis=0)


def merged(d: np.ndarray, q: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and vectors of q (diag(d) + rho z z^T) q^T, after deflation."""
    order = np.argsort(d, kind="stable")
    d, q, z = d[order].copy(), q[:, order].copy(), z[order] / np.linalg.norm(z)
    rho = rho * 2
    small = 8 * _EPS * max(np.abs(d).max(), rho)
    live, last = [], -1
    for j in range(len(d)):
        if rho * abs(z[j]) <= small:
            continue
        if last >= 0 and (d[j] - d[last]) * abs(z[j] * z[last]) <= small * (z[j] ** 2 + z[last] ** 2):
            r = np.hypot(z[last], z[j])  # two near poles: a rotation moves the weight to one of them
            c, s = z[j] / r, z[last] / r
            q[:, last], q[:, j] = c * q[:, last] - s * q[:, j], s * q[:, last] + c * q[:, j]
            d[last], d[j] = c * c * d[last] + s * s * d[j], s * s * d[last] + c * c * d[j]
            z[last], z[j] = 0.0, r
            live.pop()
        live.append(j)
        last = j
    if live:
        keep = np.array(live)[np.argsort(d[live], kind="stable")]
        d[keep], u = secular(d[keep], z[keep], rho)
        q[:, keep] = q[:, keep] @ u
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


def divide_and_conquer(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and vectors of the tridiagonal matrix with diagonal d and off-diagonal e."""
    n = len(d)
    if n == 1:
        return d.copy(), np.ones((1, 1))
    m = n // 2
    rho, first, second = abs(e[m - 1]), d[:m].copy(), d[m:].copy()
    first[-1] -= rho
    second[0] -= rho
    (w1, q1), (w2, q2) = divide_and_conquer(first, e[: m - 1]), divide_and_conquer(second, e[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    w = np.append(w1, w2)
    if rho == 0:
        order = np.argsort(w, kind="stable")
        return w[order], q[:, order]
    return merged(w, q, np.append(q1[-1], np.copysign(1.0, e[m - 1]) * q2[0]), rho)


def leading(high: np.ndarray, low: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most largest eigenvalues above rounding, falling, and their unit vectors as columns."""
    d, e, q = tridiagonal(high)
    w, u = divide_and_conquer(d, e)
    w, q = w[::-1], (q @ u)[:, ::-1]
    exact, found = high.astype(np.longdouble) + low.astype(np.longdouble), []
    for i in range(min(most, len(w))):
        if w[i] <= len(w) * _EPS * w[0]:
            break
        v = q[:, i].astype(np.longdouble)
        r, apart = exact @ v - w[i] * v, w[i] - w
        apart[np.abs(apart) <= 1e-6 * w[0]] = np.inf  # among near equal values any basis will do
        v = v + q @ ((q.T @ r) / apart)
        v /= np.sqrt(v @ v)
        found.append((float(v @ exact @ v), v.astype(float)))
    return np.array([x[0] for x in found]), np.array([x[1] for x in found]).reshape(len(found), len(w)).T


# Spark -----------------------------------------------------------------------------------


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * SCALE) < LARGEST))
    return embeddings.where(F.coalesce(usable, F.lit(False))).select("vec_id", F.transform(c, lambda v: F.floor(v * SCALE)).alias("x"))


def column_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of vectors and each dimension's exact sum."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a batch's sums fit a long: 2^40 times the rows of a batch
            x = _matrix(batch["x"], dims)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims, dtype=np.int32)), pa.array(np.append(len(x), x.sum(axis=0)))], ["dim", "total"])

    rows = fit.mapInArrow(sums, "dim int, total long").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found = {r["dim"]: int(r["total"]) for r in rows}
    return found.get(-1, 0), [found.get(k, 0) for k in range(dims)]


def covariance(fit: DataFrame, dims: int, mean: tuple, n: int) -> tuple:
    """The double-double covariance of the fit list: sums in tasks, merged by FAN_IN until one is left."""
    step = max(1, (1 << 17) // dims)  # matrix rows that travel together, 1 MB

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (np.zeros((dims, dims)), np.zeros((dims, dims)))
        for batch in batches:
            total = add(total, outer_products(centred(_matrix(batch["x"], dims), mean)))
        at = range(0, dims, step)
        cells = [pa.array([total[k][i : i + step].tobytes() for i in at], pa.binary()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(at), pa.int64()), pa.array(list(at), pa.int32()), *cells], ["part", "at", "high", "low"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = None
        for r in group.sort_values("part").itertuples():
            one = np.frombuffer(r.high), np.frombuffer(r.low)
            total = one if total is None else add(total, one)
        return pd.DataFrame({"part": [group["part"].iloc[0] // FAN_IN], "at": [group["at"].iloc[0]], "high": [total[0].tobytes()], "low": [total[1].tobytes()]})

    kind, left = "part long, at int, high binary, low binary", fit.rdd.getNumPartitions()
    sums = fit.mapInArrow(parts, kind)
    while left > 1:
        sums = sums.groupBy("at", F.expr(f"part div {FAN_IN}")).applyInPandas(merge, kind)
        left = -(-left // FAN_IN)
    rows = sorted(sums.collect(), key=lambda r: r["at"])
    high, low = (np.concatenate([np.frombuffer(r[k]) for r in rows]).reshape(dims, dims) for k in ("high", "low"))
    q = high / n
    rest = np.array([float(Fraction(h) - Fraction(v) * n) for h, v in zip(high.ravel().tolist(), q.ravel().tolist(), strict=True)]).reshape(dims, dims)
    return quick_two_sum(q, (rest + low) / n)


def identity_error(fit: DataFrame, dims: int, mean: tuple, transform: np.ndarray, n: int) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = transform.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = centred(_matrix(batch["x"], dims), mean)[0] @ transform
            y = np.column_stack([y, np.ones(len(y))])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange((k + 1) ** 2, dtype=np.int32)), pa.array((y.T @ y).ravel())], ["cell", "total"])

    rows = fit.mapInArrow(sums, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((k + 1) ** 2)
    for r in rows:
        total[r["cell"]] = r["total"] / n
    total = total.reshape(k + 1, k + 1)
    return float(np.abs(total[:k, :k] - np.outer(total[:k, k], total[:k, k]) - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each vector and leading component.

    embeddings has vec_id and embedding. Vectors that are null, empty or hold null or
    non-finite entries take no part, nor do entries of 2^32 (2^40 once scaled) or more, nor
    vectors whose length isn't the commonest (of equally common ones the longest). Rows that
    repeat a vec_id or have none are returned one by one; equal vectors count once in the
    fit. Components whose eigenvalue isn't above rounding are left out, so a single distinct
    vector gives no rows, as an empty table does. deviation is null where it exceeds a long.
    Other columns aren't read.
    """
    spark = embeddings.sparkSession
    rows = integer_vectors(embeddings)
    lengths = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], _OUT)
    dims = lengths[0]["dims"]
    rows = rows.where(F.size("x") == dims)
    fit = cut(rows.select("x").distinct())
    n, total = column_sums(fit, dims)
    means = [Fraction(s, n) for s in total]
    mean = np.array([float(m) for m in means]), np.array([float(m - Fraction(float(m))) for m in means])
    high, low = covariance(fit, dims, mean, n)
    values, vectors = leading(high, low, components)
    if not len(values):
        return spark.createDataFrame([], _OUT)
    transform, share = vectors / np.sqrt(values), values / np.trace(high)
    error, k, largest = identity_error(fit, dims, mean, transform, n), len(values), max(map(abs, total))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["x"], dims)
            y = centred(x, mean)[0] @ transform
            if dims * (n * int(np.abs(x).max(initial=0)) + largest) ** 2 < 1 << 63:
                deviation = ((n * x - np.array(total)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [v if v < 1 << 63 else None for v in (sum((n * a - s) ** 2 for a, s in zip(r, total, strict=True)) for r in x.tolist())]
            m = len(x)
            take = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch["vec_id"].cast(pa.int64()).take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(deviation, pa.int64()).take(take),
                pa.array(y.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, _OUT)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
