"""Voyages from position reports: segmentation, summaries and shape descriptors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.functions.geo import FEATURE_KM_PER_DEGREE, haversine_km, implied_speed_kn
from tidewatch.sources.shared import sliced, slices, small_batches, written

GAP_MINUTES = 60
MIN_POINTS = 6
SEQUENCE = 16
SLICE_REPORTS = 1_500_000


def by_time() -> W:
    """Every order-dependent step shares this partitioning, and so one exchange and sort."""
    return W.partitionBy("mmsi").orderBy("us", "id")


def steps(positions: DataFrame) -> DataFrame:
    """Each report with the one before of its vessel: prev_us, prev_lat, prev_lon, seconds, km, knots."""
    rows = positions.withColumns({f"prev_{c}": F.lag(c).over(by_time()) for c in ("us", "lat", "lon")})
    km = haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    rows = rows.withColumns({"seconds": (F.col("us") - F.col("prev_us")) / F.lit(1e6), "km": km})
    return rows.withColumn("knots", F.when(F.col("prev_us").isNotNull(), implied_speed_kn(F.col("km"), F.col("seconds"))))


def voyages(positions: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """steps() with a voyage number per vessel, counted from 0: a silence longer than gap_minutes begins another."""
    cut = F.when(F.col("seconds") > gap_minutes * 60, 1).otherwise(0)
    rows = steps(positions).withColumn("voyage", F.sum(cut).over(by_time()))
    return rows.withColumn("inner", F.col("prev_us").isNotNull() & (F.col("seconds") <= gap_minutes * 60))


def summaries(positions: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """One row per voyage: identity, extent in time and space, distance and largest implied speed."""
    order = F.struct("us", "id")
    inner = lambda c: F.when(F.col("inner"), F.col(c)).otherwise(0.0)
    rows = voyages(positions, gap_minutes).groupBy("mmsi", "voyage").agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("point_count"),
        F.sum(inner("km")).alias("distance_km"), F.max(inner("knots")).alias("max_implied_kn"),
        F.min_by("lat", order).alias("start_lat"), F.min_by("lon", order).alias("start_lon"), F.max_by("lat", order).alias("end_lat"), F.max_by("lon", order).alias("end_lon"),
        F.min_by("region", order).alias("region"), F.avg("sog").alias("mean_sog"),
    )
    start = F.date_format(F.timestamp_micros("start_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return rows.withColumn("track_id", F.concat("mmsi", F.lit(":"), start))


_SHAPE = "mmsi string, voyage long, start_us long, features array<double>, sequence array<array<double>>"


def shape(us: np.ndarray, lat: np.ndarray, lon: np.ndarray, sog: np.ndarray, n: int) -> tuple[list[float], list[list[float]]]:
    """Heading-invariant descriptors of a path: n resampled points in km with the mean speed, and its steps."""
    at = np.linspace(us[0], us[-1], n)
    lats, lons = (np.full(n, v[0]) if us[0] == us[-1] else np.interp(at, us, v) for v in (lat, lon))
    x = (lons - lons[0]) * FEATURE_KM_PER_DEGREE * np.cos(np.radians(lats[0]))
    y = (lats - lats[0]) * FEATURE_KM_PER_DEGREE
    turn = -np.arctan2(y[-1], x[-1])
    along, across = np.cos(turn) * x - np.sin(turn) * y, np.sin(turn) * x + np.cos(turn) * y
    known = sog[~np.isnan(sog)]
    features = np.round(np.stack([along, across], axis=1), 4).ravel().tolist() + [round(float(known.mean()), 3) if len(known) else 0.0]
    dx, dy = np.diff(along), np.diff(across)
    angle = np.arctan2(dy, dx)
    return features, np.stack([dx, dy, np.hypot(dx, dy), np.diff(angle, prepend=angle[0])], axis=1).tolist()


def shapes(positions: DataFrame, n: int = SEQUENCE, min_points: int = MIN_POINTS, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """features (2n + 1 numbers) and sequence (n - 1 steps of dx, dy, length, turn) of voyages with min_points or more.

    A voyage travels as one row, whose arrays end at the next silence.
    """
    small_batches(positions.sparkSession)
    points = F.sort_array(F.collect_list(F.struct("us", "id", "lat", "lon", "sog")))
    rows = voyages(positions, gap_minutes).groupBy("mmsi", "voyage").agg(points.alias("p")).where(F.size("p") >= min_points)
    rows = rows.select("mmsi", "voyage", *[F.col(f"p.{c}").alias(c) for c in ("us", "lat", "lon", "sog")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [shape(np.array(u, float), np.array(a, float), np.array(o, float), np.array(s, float), n) for u, a, o, s in zip(batch["us"], batch["lat"], batch["lon"], batch["sog"], strict=True)]
            yield pd.DataFrame({"mmsi": batch["mmsi"], "voyage": batch["voyage"], "start_us": [int(u[0]) for u in batch["us"]], "features": [m[0] for m in made], "sequence": [m[1] for m in made]})

    return rows.mapInPandas(run, _SHAPE)


def stored_shapes(positions: DataFrame, *columns: str) -> DataFrame:
    """shapes(), or the named columns of it, written; the vessels of many reports are taken in slices, since shapes are as large as what is shuffled for them."""
    made = lambda part: shapes(part(positions)).select(*columns or ["*"])
    n = slices(positions.count(), SLICE_REPORTS)
    rows = sliced(n, F.xxhash64("mmsi"), made)
    return rows if n > 1 else written(rows)


def simplified(lat: np.ndarray, lon: np.ndarray, tolerance_km: float) -> np.ndarray:
    """Indices kept by farthest-point splitting (end points always); distances on a flat grid at the mean latitude."""
    n = len(lat)
    x, y = lon * FEATURE_KM_PER_DEGREE * np.cos(np.radians(lat.mean())), lat * FEATURE_KM_PER_DEGREE
    keep, spans = {0, n - 1}, [(0, n - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        dx, dy, length = x[b] - x[a], y[b] - y[a], float(np.hypot(x[b] - x[a], y[b] - y[a]))
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        away = np.abs(dx * py - dy * px) / length if length else np.hypot(px, py)
        k = int(np.argmax(away))
        if away[k] > tolerance_km:
            keep.add(a + 1 + k)
            spans += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.array(sorted(keep))


def polylines(positions: DataFrame, tolerance_km: float = 0.05, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """(mmsi, voyage, n_points, n_kept, kept): the reports that a simplified line keeps of each voyage."""
    small_batches(positions.sparkSession)
    points = F.sort_array(F.collect_list(F.struct("us", "id", "lat", "lon")))
    rows = voyages(positions, gap_minutes).groupBy("mmsi", "voyage").agg(points.alias("p")).select("mmsi", "voyage", F.col("p.id").alias("id"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = [np.asarray(i)[simplified(np.asarray(a, float), np.asarray(o, float), tolerance_km)].tolist() if len(i) > 2 else list(i) for i, a, o in zip(batch["id"], batch["lat"], batch["lon"], strict=True)]
            yield pd.DataFrame({"mmsi": batch["mmsi"], "voyage": batch["voyage"], "n_points": [len(i) for i in batch["id"]], "n_kept": [len(k) for k in kept], "kept": kept})

    return rows.mapInPandas(run, "mmsi string, voyage long, n_points long, n_kept long, kept array<long>")
