"""The registered queries of the maritime engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import zones
from tidewatch.functions.grading import public_id
from tidewatch.operators import anomaly, detect, downsample, evaluate, fusion, incremental, intervals, matching, publish, tracks, training, upkeep
from tidewatch.plans import feed_queries, ledgers, oracles
from tidewatch.plans.inputs import NOW, deterministic, events, made_tracks, outages, path_matches, runs, settled, stored_tracks, written
from tidewatch.sources import lens

Query = Callable[[SparkSession, str], DataFrame]
Found = Callable[[SparkSession, str], DataFrame]


def _kinematic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of the two detectors that look at a vessel's steps alone."""
    p = lens.positions(spark, sf_dir)
    return detect.gaps(p, outages(spark)).unionByName(detect.spoofs(p))


def _judged(spark: SparkSession, sf_dir: str, every: DataFrame | None = None) -> tuple[DataFrame, DataFrame, anomaly.SequenceModel | None]:
    """The findings of all five detectors and the errors of voyages, each written once, and the model, if there are enough voyages to fit one.

    Shapes are removed before the other detectors begin. every are the tracks, if they are at hand.
    """
    p, models = lens.positions(spark, sf_dir), []

    def errors() -> DataFrame:
        made = tracks.stored_shapes(p, "mmsi", "voyage", "start_us", "sequence")
        models.append(anomaly.fitted(made))
        return anomaly.errors_of(made, models[0])

    scored = settled(spark, errors)
    (model,) = models
    found = settled(spark, lambda: detect.all_incidents(p, outages(spark)).unionByName(anomaly.unusual(scored, tracks.summaries(p) if every is None else every, model)))
    return found, scored, model


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)[0]


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.round(c, 9).alias(c) if c in ("lat", "lon") else F.array_join(c, ",").alias(c) if c == "techniques" else F.col(c) for c in detect.COLUMNS if c not in ("counterpart_mmsi", "region", "evidence")])


def _threat(rows: DataFrame) -> DataFrame:
    return fusion.fuse(rows).select("mmsi", "n_incidents", "n_detectors", "detectors", "techniques", "max_score", "best_reliability", "risk", "severity")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of each vessel, fused from all detectors, the riskiest first."""
    return fusion.fuse(_findings(spark, sf_dir)).orderBy(F.desc("risk"), "mmsi")


def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lens.positions(spark, sf_dir).select("id", "mmsi", F.expr("us div 7200000000").alias("us"))
    return upkeep.new_positions(p.where("id % 4 <> 0"), p.where("id % 4 = 0"))


def _stats(spark: SparkSession, sf_dir: str, found: Found = deterministic) -> DataFrame:
    names = spark.createDataFrame([("gap",), ("spoof",), ("loiter",), ("rendezvous",), ("anomaly",)], "detector string")
    counts = found(spark, sf_dir).groupBy("detector").agg(F.count("*").alias("incidents"), F.count_distinct("mmsi").alias("vessels"))
    return names.join(counts, "detector", "left").fillna(0)


def _truth(spark: SparkSession) -> DataFrame:
    return events(spark).select(F.col("event_id").alias("truth_id"), "kind", "mmsi", F.col("ts_us").alias("ts_start_us"), F.col("ts_us").alias("ts_end_us"))


def _wilson(spark: SparkSession, sf_dir: str, found: Found = deterministic) -> DataFrame:
    return evaluate.precision_intervals(found(spark, sf_dir).withColumn("confirmed", F.expr("ts_start_us div 1000000 % 3 = 0")))


def _auc(spark: SparkSession, sf_dir: str, found: Found = deterministic) -> DataFrame:
    rows = found(spark, sf_dir).select("score", (F.col("detector") == "spoof").alias("positive"), (F.lit(1.0) + F.expr("ts_start_us div 1000000 % 4")).alias("weight"))
    return evaluate.weighted_auc(rows, "score", "positive", "weight")


def _attributed(spark: SparkSession, sf_dir: str, found: Found = deterministic) -> DataFrame:
    return matching.incident_tracks(found(spark, sf_dir), made_tracks(spark, sf_dir))


def _anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tracks.stored_shapes(lens.positions(spark, sf_dir))
    return _shown(anomaly.anomalies(made, made_tracks(spark, sf_dir), anomaly.fitted(made)))


def _baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tracks.stored_shapes(lens.positions(spark, sf_dir))
    if made.limit(anomaly.MIN_VOYAGES).count() < anomaly.MIN_VOYAGES:
        return made.where(F.lit(False)).select("mmsi", "voyage", "start_us", F.lit(0.0).alias("pca_error"), F.lit(0.0).alias("forest_error"))
    pca = anomaly.scored(made, training.components(made), "features").withColumnRenamed("error", "pca_error")
    forest = anomaly.scored(made, training.forest(made), "features").withColumnRenamed("error", "forest_error")
    return pca.join(forest.drop("start_us"), ["mmsi", "voyage"])


def _capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voyages that imply impossible speeds are what models of two sizes, each with three seeds, are to find."""
    p = lens.positions(spark, sf_dir)
    labels = tracks.summaries(p).select("mmsi", "voyage", (F.col("max_implied_kn") > 60).alias("anomalous"))
    return training.capacity(tracks.stored_shapes(p, "mmsi", "voyage", "start_us", "sequence"), labels, (4, 8), (0, 1, 2), most=600, epochs=60)


def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = stored_tracks(spark, sf_dir)
    found, errors, model = _judged(spark, sf_dir, every)
    return evaluate.review_pools(every, matching.incident_tracks(found, every), found, path_matches(spark, sf_dir, every), errors, model and model.threshold)


_CUT = lens.EPOCH_US + 20 * 3_600_000_000


def _refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks built from the first hours and refreshed with the rest."""
    p = lens.positions(spark, sf_dir)
    stored = tracks.summaries(p.where(F.col("us") < _CUT))
    done = incremental.refreshed_tracks(p, stored, upkeep.dirty_backlog(p, stored))
    return done.select("track_id", "mmsi", "voyage", "start_us", "end_us", "point_count")


def _pilot(spark: SparkSession, sf_dir: str, found: Found = deterministic) -> DataFrame:
    spans = intervals.observed(runs(spark), outages(spark), NOW)
    return evaluate.pilot_figures(runs(spark), outages(spark), spans, intervals.overlap_hours(made_tracks(spark, sf_dir), spans), found(spark, sf_dir), NOW)


def _external(spark: SparkSession, sf_dir: str, found: Found) -> DataFrame:
    rows = found(spark, sf_dir)
    return evaluate.external_rates(rows, matching.corroborated(rows, events(spark)))


def _readers(found: Found) -> dict[str, Query]:
    """The queries that read findings, by the source of these."""
    return {
        "public_incidents": lambda s, d: publish.public_incidents(found(s, d), NOW),
        "incident_track_attribution": lambda s, d: _attributed(s, d, found),
        "corroborated_incidents": lambda s, d: matching.corroborated(found(s, d), events(s)).select("incident_id"),
        "pilot_figures": lambda s, d: _pilot(s, d, found),
        "external_agreement": lambda s, d: _external(s, d, found),
        "incident_topk": lambda s, d: fusion.ranked(found(s, d), 50).select("incident_id", "score"),
        "score_drift": lambda s, d: evaluate.drift(found(s, d), lens.vessels(s, d)),
        "detector_pr": lambda s, d: evaluate.detector_scores(found(s, d), _truth(s)),
        "wilson_precision": lambda s, d: _wilson(s, d, found),
        "roc_auc": lambda s, d: _auc(s, d, found),
        "stats_by_detector": lambda s, d: _stats(s, d, found),
        "geoint_evidence": lambda s, d: fusion.evidence(found(s, d)).select("incident_id", "mmsi", "detector", "severity", "reliability", "credibility", public_id(F.col("incident_id")).alias("public_id")),
    }


def queries() -> dict[str, Query]:
    """Every query. Those that read findings exist twice: over the four detectors that their SQL
    can follow, and, named NAME_all, over all five.
    """
    pos = lens.positions
    return {
        "position_reports": lambda s, d: pos(s, d).select("id", "mmsi", "us", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), F.round("sog", 6).alias("sog")),
        "haversine_steps": lambda s, d: tracks.steps(pos(s, d)).where("prev_us IS NOT NULL").select("id", "mmsi", "us", "seconds", F.round("km", 6).alias("km"), F.round("knots", 4).alias("knots")),
        "voyage_segments": lambda s, d: tracks.voyages(pos(s, d)).select("id", "mmsi", "us", "voyage"),
        "track_summary": lambda s, d: made_tracks(s, d).select("track_id", "mmsi", "voyage", "start_us", "end_us", "point_count", F.round("distance_km", 6).alias("distance_km"), F.round("max_implied_kn", 4).alias("max_implied_kn"), F.round("start_lat", 9).alias("start_lat"), F.round("end_lon", 9).alias("end_lon"), F.round("mean_sog", 6).alias("mean_sog")),
        "track_shapes": lambda s, d: tracks.shapes(pos(s, d)),
        "polyline_simplify": lambda s, d: tracks.polylines(pos(s, d)),
        "gap_coverage": lambda s, d: detect.coverage(detect.gap_segments(pos(s, d), outages(s)), pos(s, d)).select("id", "mmsi", "witnessed", "witnesses", F.round("support", 6).alias("support"), "verdict"),
        "gap_incidents": lambda s, d: _shown(detect.gaps(pos(s, d), outages(s))),
        "spoof_incidents": lambda s, d: _shown(detect.spoofs(pos(s, d))),
        "loiter_incidents": lambda s, d: _shown(detect.loiters(pos(s, d))),
        "rendezvous_candidates": lambda s, d: detect.meeting_candidates(pos(s, d)),
        "rendezvous_incidents": lambda s, d: _shown(detect.rendezvous(pos(s, d))),
        "near_moments": lambda s, d: detect.near_moments(pos(s, d)).select("a", "b", "k", "us", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), F.round("km", 9).alias("km")),
        "partner_degree": lambda s, d: detect.partner_degree(detect.meetings(pos(s, d))),
        "anomaly_incidents": _anomalies,
        "anomaly_baselines": _baselines,
        "capacity_sweep": _capacity,
        "zone_attribution": lambda s, d: pos(s, d).select("id", zones.zone_of(F.col("lat"), F.col("lon")).alias("zone_id"), zones.in_kind(F.col("lat"), F.col("lon"), "port").alias("in_port")),
        "witness_index": lambda s, d: detect.witness_index(pos(s, d)),
        "footprint_profile": lambda s, d: evaluate.footprint(pos(s, d)),
        "observed_vessel_hours": lambda s, d: intervals.overlap_hours(made_tracks(s, d), intervals.observed(runs(s), outages(s), NOW)),
        "event_track_match": lambda s, d: matching.event_matches(events(s), made_tracks(s, d)),
        "position_dedup": _dedup,
        "vessel_dimension": lambda s, d: upkeep.vessel_dimension(pos(s, d)),
        "dirty_backlog": lambda s, d: upkeep.dirty_backlog(pos(s, d), made_tracks(s, d).where("voyage < 6")),
        "incremental_tracks": _refreshed,
        "retention": lambda s, d: upkeep.pruned(pos(s, d), lens.EPOCH_US + 43_200_000_000, days=0).select("id"),
        "downsample_positions": lambda s, d: downsample.downsampled(pos(s, d), seconds=1800.0, turn=120.0, speed=5.0).select("id", "mmsi"),
        "vessel_threat_kinematic": lambda s, d: _threat(_kinematic(s, d)),
        "vessel_threat_deterministic": lambda s, d: _threat(deterministic(s, d)),
        "vessel_threat_rollup": flagship,
        "cohort_select": lambda s, d: evaluate.cohort(pos(s, d), events(s).where("mmsi IS NOT NULL").select("mmsi"), 20, 6),
        "review_pools": _pools,
        "review_queue": lambda s, d: evaluate.review_queue(written(_pools(s, d))),
    } | feed_queries.queries() | {name: query for name, (query, _) in ledgers.TABLE.items()} | _readers(deterministic) | {f"{name}_all": query for name, query in _readers(_findings).items()}


def oracle_sql() -> dict[str, str]:
    return oracles.ORACLES | feed_queries.oracle_sql() | {name: sql for name, (_, sql) in ledgers.TABLE.items()}
