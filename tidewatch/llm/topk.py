"""Exact top-k inner products with MaxScore over shards.

A dimension of a vector plays the part of a term: its posting holds the vectors' integer
components. In a shard a dimension adds at most |q| times the width of its components'
range to what all vectors have at least. Dimensions are ordered by this bound. The lightest
ones which, all together, can't lift a vector to the query's k-th best score so far are
non-essential. The essential ones are traversed for the shard's vectors; the others are
probed, heaviest first, only for vectors that can still compete. The k-th best is carried
from shard to shard of a task, so the split moves as it rises, up to shards that hold
nothing essential and are passed over. Queries are broadcast in slices of bounded size; every
task returns at most k rows a query, and a last aggregation merges them.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.llm.tables import cut, sized, table

K = 5
EVERY = 50
SCALE = 256
SHARD_ROWS = 2_048
SLICE_BYTES = 1 << 25
SEED_ROWS = 1_024
PROBE = 8
_WIDEST = 10**38 - 1
_DOUBLE, _LONG, _NONE = float(1 << 53), float(1 << 61), -(1 << 62)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and components floor(scale * x) of the vectors in which all are finite, row by row.

    Vectors that are null or empty, or hold a null, NaN or infinite component, and rows
    with a null vec_id take no part. Components are cut at the ends of a long. Rows that repeat a vec_id all stay.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good = vectors.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(F.coalesce(whole, F.lit(False)))
    return good.select("vec_id", F.transform("x", lambda v: F.floor(v * scale)).alias("q"))


class Search:
    """The k best vectors so far of each query of one number of dimensions, by the slots of the queries' rows; work counts component products."""

    def __init__(self, slots: np.ndarray, q: np.ndarray, k: int):
        self.slots, self.q, self.k, self.work = slots, q, k, 0
        self.none = -(1 << 200) if q.dtype == object else q.dtype.type(_NONE)
        self.score = np.full((len(slots), k), self.none, q.dtype)
        self.held = np.full((len(slots), k), np.iinfo(np.int64).max)
        self.least = np.full(len(slots), self.none, q.dtype)  # no worse vector than this is among the best

    def seed(self, rows: int = SEED_ROWS) -> Search:
        """Starts from the k-th best among some of the queries, which are candidates themselves."""
        if len(self.slots) > self.k:
            some = np.arange(min(rows, len(self.slots)))
            score = self.q @ self.q[some].T
            score[some, some] = self.none
            if len(some) > self.k:
                self.least = (np.sort(score, axis=1) if score.dtype == object else np.partition(score, -self.k, axis=1))[:, -self.k]
        return self

    def shard(self, slots: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Looks through a shard of vectors x with the slots of their rows and their vec_ids."""
        high, low = x.max(axis=0), x.min(axis=0)
        spread = np.abs(self.q) * (high - low)
        base = np.minimum(self.q * high, self.q * low).sum(axis=1)
        order = np.argsort(spread, axis=1, kind="stable")
        bound = base[:, None] + np.cumsum(np.take_along_axis(spread, order, axis=1), axis=1)  # bound[:, j]: with the j + 1 lightest
        light = (bound < self.least[:, None]).sum(axis=1)
        columns = np.ascontiguousarray(x.T)
        for i in np.flatnonzero(light < x.shape[1]).tolist():
            self._query(i, slots, ids, columns, order[i], int(light[i]), np.maximum(self.q[i] * high, self.q[i] * low))

    def _query(self, i: int, slots: np.ndarray, ids: np.ndarray, columns: np.ndarray, order: np.ndarray, light: int, most: np.ndarray) -> None:
        q, least = self.q[i], self.least[i]
        essential = order[light:]
        score = q[essential] @ columns[essential]
        alive = np.flatnonzero((score + most[order[:light]].sum() >= least) & (slots != self.slots[i]))
        score = score[alive]
        self.work += len(essential) * len(ids)
        for j in range(light, 0, -PROBE):
            step = order[max(0, j - PROBE) : j]
            score = score + q[step] @ columns[np.ix_(step, alive)]
            self.work += len(step) * len(alive)
            keep = score + most[order[: max(0, j - PROBE)]].sum() >= least
            alive, score = alive[keep], score[keep]
            if not len(alive):
                return
        score, held = np.concatenate([self.score[i], score]), np.concatenate([self.held[i], ids[alive]])
        top = sorted(range(len(held)), key=lambda t: (-score[t], held[t]))[: self.k] if score.dtype == object else np.lexsort((held, -score))[: self.k]
        self.score[i], self.held[i] = score[top], held[top]
        self.least[i] = max(self.least[i], self.score[i, -1])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's slot, vector, score) of what is held."""
        i, j = np.nonzero(self.score > self.none)
        return self.slots[i], self.held[i, j], self.score[i, j]


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimensions, slots, ids, components) of a batch's vectors, by number of dimensions."""
    slots, ids, lists = batch["slot"].to_numpy(), batch["vec_id"].to_numpy(), batch["q"]
    dims = lists.value_lengths().to_numpy()
    values, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(dims)])
    for d in np.unique(dims).tolist():
        mine = np.flatnonzero(dims == d)
        yield d, slots[mine], ids[mine], values[ends[mine][:, None] + np.arange(d)]


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, shard_rows: int = SHARD_ROWS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors with the largest integer inner product with each query.

    Queries are the rows whose vec_id is divisible by every, candidates all other rows with
    the same number of dimensions; ties go to the smaller vec_id; with fewer than k candidates
    all are returned. Rows that repeat a vec_id are queries and candidates one by one: each
    has its own ranking, in which the other is a candidate. Very large components are
    multiplied as Python's integers; a score beyond a long is ranked as it is and returned as
    null. Rows that quantised() leaves out, and an empty table, return nothing.
    """
    rows = cut(quantised(vectors, scale).withColumn("slot", F.monotonically_increasing_id()))
    asked = rows.where(F.col("vec_id") % every == 0)
    n, wide = asked.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(1))).first()
    large = rows.agg(F.coalesce(F.max(F.aggregate("q", F.lit(0.0), lambda m, v: F.greatest(m, F.abs(v.cast("double"))))), F.lit(0.0))).first()[0]
    most = large * large * wide
    kind = np.float64 if most < _DOUBLE else np.int64 if most < _LONG else object  # doubles are exact up to 2^53
    slices = max(1, -(-n * wide * 8 // slice_bytes))
    parts = [_slice(rows, asked.where(F.pmod(F.xxhash64("slot"), F.lit(slices)) == s), k, shard_rows, kind) for s in range(slices)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = W.partitionBy("slot").orderBy(F.desc("score"), "vec_id")
    found = found.join(sized(asked.select("slot", F.col("vec_id").alias("query_id"))), "slot")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.expr("try_cast(score AS long)").alias("score"))


def _slice(rows: DataFrame, asked: DataFrame, k: int, shard_rows: int, kind: type) -> DataFrame:
    queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in asked.select("slot", "vec_id", "q").toArrow().to_batches():
        for d, slots, _, q in _matrices(batch):
            before = queries.get(d, (slots[:0], q[:0].astype(kind)))
            queries[d] = np.concatenate([before[0], slots]), np.concatenate([before[1], q.astype(kind)])
    sent = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches: dict[int, Search] = {}
        waiting: dict[int, list] = {}

        def search(d: int) -> None:
            if d not in searches:
                searches[d] = Search(*sent.value[d], k).seed()
            parts = waiting.pop(d)
            searches[d].shard(*(np.concatenate([p[k] for p in parts]) for k in range(3)))

        for batch in batches:
            for d, slots, ids, x in _matrices(batch):
                if d in sent.value:
                    waiting.setdefault(d, []).append((slots, ids, x.astype(kind)))
                    if sum(len(p[0]) for p in waiting[d]) >= shard_rows:
                        search(d)
        for d in list(waiting):
            search(d)
        for s in searches.values():
            slots, ids, score = s.best()
            score = pa.array([Decimal(max(-_WIDEST, min(_WIDEST, v))) for v in score.tolist()], pa.decimal128(38)) if kind is object else pa.array(score.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(ids), score], ["slot", "vec_id", "score"])

    found = cut(rows.select("slot", "vec_id", "q").mapInArrow(run, f"slot long, vec_id long, score {'decimal(38,0)' if kind is object else 'long'}"))
    sent.unpersist()
    return found


def op9_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP9_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
