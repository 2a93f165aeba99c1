"""Small aggregates that reports quote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordered import quantiles


def label_versions(events: DataFrame) -> DataFrame:
    """Per source: how many labels, and when the last one was retrieved."""
    return events.groupBy("source").agg(F.count("*").alias("n"), F.max("retrieved_us").alias("cutoff_us"))


def data_snapshot(positions: DataFrame, tracks: DataFrame, incidents: DataFrame, spans: DataFrame) -> DataFrame:
    """One row: sizes of the tables, first and last report, hours observed."""
    p = positions.agg(F.count("*").alias("positions"), F.count_distinct("mmsi").alias("vessels"), F.min("us").alias("min_us"), F.max("us").alias("max_us"))
    others = [tracks.agg(F.count("*").alias("tracks")), incidents.agg(F.count("*").alias("incidents")), spans.agg(F.round(F.coalesce(F.sum(F.col("end_us") - F.col("start_us")), F.lit(0)) / F.lit(3.6e9), 6).alias("observed_hours"))]
    for one in others:  # single rows
        p = p.crossJoin(one)
    return p


def recent_counts(incidents: DataFrame, now_us: int, hours: int = 24) -> DataFrame:
    return incidents.where(F.col("ts_start_us") >= now_us - hours * 3_600_000_000).groupBy("detector").agg(F.count("*").alias("n"))


def score_levels(incidents: DataFrame, now_us: int, hours: int = 24) -> DataFrame:
    """One row: median and 95th percentile of all scores and of the last hours'; null where there are none."""
    names = F.when(F.col("ts_start_us") >= now_us - hours * 3_600_000_000, F.array(F.lit("all"), F.lit("recent"))).otherwise(F.array(F.lit("all")))
    found = quantiles(incidents.select(F.explode(names).alias("g"), "score"), "score", {"p50": 0.5, "p95": 0.95}, ["g"])
    return found.agg(*[F.round(F.max(F.when(F.col("g") == n, F.col(k))), 6).alias(f"{n}_{k}") for n in ("all", "recent") for k in ("p50", "p95")])


def verdict_counts(gaps: DataFrame) -> DataFrame:
    """Per coverage verdict: gaps, and how many have each grade, without and with what coverage tells."""
    graded = gaps.groupBy("verdict").agg(F.count("*").alias("n"), *[F.sum((F.col(c) == g).cast("int")).alias(f"{c}_{g.lower()}") for c in ("before", "after") for g in "BCDEF"])
    return graded


def over_seeds(runs: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Per metric: mean of its runs (NaN left out), spread and least."""
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    return runs.groupBy(metric).agg(F.round(F.avg(v), 3).alias("mean"), F.round(F.stddev_pop(v), 3).alias("spread"), F.min(v).alias("least"), F.count(v).alias("n"))


def most_unusual(errors: DataFrame, tracks: DataFrame, limit: int = 6) -> DataFrame:
    """The tracks that the model reconstructs worst."""
    return errors.join(tracks.select("mmsi", "voyage", "track_id"), ["mmsi", "voyage"]).orderBy(F.desc("error"), "track_id").limit(limit).select("track_id", "error")
