"""Evaluation: rates, discrimination, drift, cohorts and review queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.functions.grading import wilson
from tidewatch.operators import ordered


def detector_scores(incidents: DataFrame, truth: DataFrame, tolerance_us: int = 1_800_000_000) -> DataFrame:
    """Per detector: truths found, incidents that found one, precision and recall (1 where there was nothing to find)."""
    t = truth.select(F.col("truth_id"), F.col("kind").alias("detector"), F.col("mmsi").alias("t_mmsi"), F.col("ts_start_us").alias("t0"), F.col("ts_end_us").alias("t1"))
    met = incidents.alias("i").join(t.alias("t"), (F.col("i.detector") == F.col("t.detector")) & (F.col("mmsi") == F.col("t_mmsi")) & (F.greatest("ts_start_us", "t0") <= F.least("ts_end_us", "t1") + tolerance_us))
    hits = met.groupBy(F.col("i.detector").alias("detector")).agg(F.count_distinct("truth_id").alias("found"), F.count_distinct("incident_id").alias("hits"))
    rows = incidents.groupBy("detector").agg(F.count_distinct("incident_id").alias("incidents")).join(truth.groupBy(F.col("kind").alias("detector")).agg(F.count_distinct("truth_id").alias("truths")), "detector", "full_outer").join(hits, "detector", "left").fillna(0)
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(1.0)
    return rows.select("detector", "incidents", "truths", "found", "hits", rate("hits", "incidents").alias("precision"), rate("found", "truths").alias("recall"))


def weighted_auc(rows: DataFrame, score: str, positive: str, weight: str) -> DataFrame:
    """One row: exact weighted ROC AUC (ties half) and average precision (a step sum); null where a class is empty.

    Rows without a score, class or weight don't count. Weights are added up per distinct score, the scores are dealt to
    range partitions, and running sums over all of them come from the partitions' totals.
    """
    w, y = F.col(weight).cast("double"), F.col(positive)
    good = rows.where(F.col(score).isNotNull() & y.isNotNull() & w.isNotNull())
    by_score = good.groupBy(F.col(score).alias("_score")).agg(F.sum(F.when(y, w).otherwise(0.0)).alias("p"), F.sum(F.when(~y, w).otherwise(0.0)).alias("n"))
    swept = ordered.running(by_score, ["_score"], {"p_below": F.col("p"), "n_below": F.col("n")})
    whole = good.agg(F.coalesce(F.sum(F.when(y, w)), F.lit(0.0)).alias("pos"), F.coalesce(F.sum(F.when(~y, w)), F.lit(0.0)).alias("neg"))
    tp, fp = F.col("pos") - F.col("p_below"), F.col("neg") - F.col("n_below")
    sums = swept.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("p") * (F.col("n_below") + F.col("n") / 2)).alias("wins"), F.sum(F.when(F.col("p") > 0, F.col("p") * tp / (tp + fp)).otherwise(0.0)).alias("steps"))
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    total = whole.crossJoin(sums)  # single rows
    return total.select(F.round(F.when(both, F.col("wins") / (F.col("pos") * F.col("neg"))), 6).alias("roc_auc"), F.round(F.when(both, F.col("steps") / F.col("pos")), 6).alias("average_precision"))


def precision_intervals(reviews: DataFrame, least: int = 5) -> DataFrame:
    """Per detector: reviewed, confirmed, precision and its 95 % interval; not estimable below least confirmations."""
    rows = reviews.groupBy("detector").agg(F.count("*").alias("n"), F.sum(F.col("confirmed").cast("int")).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return rows.select("detector", "n", "k", F.round(F.col("k") / F.col("n"), 6).alias("precision"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), (F.col("k") >= least).alias("estimable"))


def drift(incidents: DataFrame, vessels: DataFrame) -> DataFrame:
    """Median and 95th percentile of scores by day and type of vessel."""
    day = F.floor(F.col("ts_start_us") / F.lit(86_400_000_000)).alias("day")
    rows = incidents.join(vessels.select("mmsi", "ship_type"), "mmsi", "left").withColumn("vessel_type", F.coalesce("ship_type", F.lit("unknown")))
    found = ordered.quantiles(rows.select(day, "vessel_type", "score"), "score", {"p50": 0.5, "p95": 0.95}, ["day", "vessel_type"])
    return found.select("day", "vessel_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def footprint(positions: DataFrame, band: float = 0.5, cell: float = 0.25) -> DataFrame:
    """Distinct vessels and cells by band of latitude, from the north."""
    rows = positions.select(F.floor(F.col("lat") / band).alias("b"), "mmsi", F.concat_ws(":", F.floor(F.col("lat") / cell), F.floor(F.col("lon") / cell)).alias("c"))
    return rows.groupBy("b").agg(F.count_distinct("mmsi").alias("vessels"), F.count_distinct("c").alias("cells")).select((F.col("b") * F.lit(band)).alias("lat_from"), "vessels", "cells")


def cohort(positions: DataFrame, labelled: DataFrame, background: int = 20, least: int = 6) -> DataFrame:
    """Labelled vessels and a deterministic background of others, all with enough reports; ordered by a digest of the id."""
    enough = positions.groupBy("mmsi").agg(F.count("*").alias("reports")).where(F.col("reports") >= least)
    own = enough.join(labelled.select("mmsi").distinct(), "mmsi", "left_semi").withColumn("part", F.lit("labelled"))
    rest = enough.join(labelled.select("mmsi"), "mmsi", "left_anti").orderBy(F.sha2("mmsi", 256)).limit(background).withColumn("part", F.lit("background"))
    return own.unionByName(rest)


def review_pools(tracks: DataFrame, incident_tracks: DataFrame, findings: DataFrame, matches: DataFrame, errors: DataFrame, threshold: float | None) -> DataFrame:
    """track_id, stratum, alert: each track's one stratum, the first that fits, and its highest score.

    In order: matched by an external event, artifact (a spoof, or an incident whose evidence
    has an implied speed), other alert, a model error of 0.8 to 1.2 of the threshold, rest.
    errors are (mmsi, voyage, error) of scored voyages; without a threshold none is near.
    """
    speedy = (F.col("detector") == "spoof") | F.col("evidence.implied_speed_kn").isNotNull()
    alerts = incident_tracks.select("incident_id", "track_id").join(findings.select("incident_id", speedy.cast("int").alias("artifact"), "score"), "incident_id").groupBy("track_id").agg(F.max("artifact").alias("artifact"), F.max("score").alias("alert"))
    external = matches.where(F.col("track_id").isNotNull() & F.col("status").isin("matched", "ambiguous")).select("track_id").distinct().withColumn("external", F.lit(True))
    near = F.col("error").between(0.8 * threshold, 1.2 * threshold) if threshold is not None else F.lit(False)
    rows = tracks.select("track_id", "mmsi", "voyage").join(errors.select("mmsi", "voyage", "error"), ["mmsi", "voyage"], "left").join(alerts, "track_id", "left").join(external, "track_id", "left")
    stratum = F.when(F.col("external"), "external-event").when(F.col("artifact") == 1, "ais-artifact-candidate").when(F.col("alert").isNotNull(), "alert").when(near, "near-threshold").otherwise("rest")
    return rows.select("track_id", stratum.alias("stratum"), "alert")


QUEUE_CAPS = {"external-event": 100, "ais-artifact-candidate": 40, "alert": 60, "near-threshold": 44}
QUEUE_LEAST, REST_LEAST = 220, 40


def review_queue(pools: DataFrame, caps: dict[str, int] = QUEUE_CAPS, least: int = QUEUE_LEAST, rest: int = REST_LEAST, seed: str = "queue-v1") -> DataFrame:
    """A sample of each stratum with its inclusion probability and place in the queue; the caps are the sampling design.

    Alerts come by their scores, the others in a seeded order. The rest fills the queue up to
    least items and has some of its own in any case. The queue's order is seeded anew.
    """
    rows = pools.withColumn("digest", F.sha2(F.concat(F.lit(seed), "track_id"), 256))
    sizes = {r["stratum"]: r["n"] for r in pools.groupBy("stratum").agg(F.count("*").alias("n")).collect()}  # five strata
    taken = {s: min(n, sizes.get(s, 0)) for s, n in caps.items()}
    taken["rest"] = min(max(least - sum(taken.values()), rest), sizes.get("rest", 0))
    chosen = None
    for s, n in sorted(taken.items()):  # the first n of a stratum: every task hands on n rows at most
        order = [F.desc("alert"), "track_id"] if s == "alert" else ["digest", "track_id"]
        part = rows.where(F.col("stratum") == s).orderBy(*order).limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    rate = F.create_map(*[F.lit(x) for s, n in taken.items() for x in (s, round(n / sizes[s], 6) if sizes.get(s) else 0.0)])
    place = F.row_number().over(W.orderBy(F.sha2(F.concat(F.lit(seed), "digest"), 256), "track_id"))  # of the sample, whose size the design fixes
    return chosen.withColumn("queue_order", place).select("track_id", "stratum", rate[F.col("stratum")].alias("probability"), "queue_order")


def pilot_figures(runs: DataFrame, outages: DataFrame, spans: DataFrame, hours: DataFrame, incidents: DataFrame, now_us: int) -> DataFrame:
    """One row: hours of outage, reconnects, share of time observed, vessel-hours observed and alerts per 100 of them."""
    hour = F.lit(3.6e9)
    out = outages.agg(F.round(F.sum(F.greatest(F.lit(0), F.least(F.coalesce("closed_us", F.lit(now_us)), F.lit(now_us)) - F.col("opened_us"))) / hour, 6).alias("outage_hours"))
    ran = runs.agg((F.count("*") - 1).alias("reconnects"), F.min("started_us").alias("since"))
    seen = spans.agg(F.sum(F.col("end_us") - F.col("start_us")).alias("seen"))
    vessel = hours.agg(F.round(F.sum("observed_hours"), 4).alias("vessel_hours"))
    alerts = incidents.agg(F.count("*").alias("alerts"))
    one = out.crossJoin(ran).crossJoin(seen).crossJoin(vessel).crossJoin(alerts)  # single rows
    rate = F.when(F.col("vessel_hours") > 0, F.round(100 * F.col("alerts") / F.col("vessel_hours"), 4))
    return one.select("outage_hours", "reconnects", F.round(F.col("seen") / (F.lit(now_us) - F.col("since")), 6).alias("uptime"), "vessel_hours", "alerts", rate.alias("alerts_per_100_hours"))


def agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per label of the first review: how many tracks were reviewed again and how many labels agreed."""
    both = first.select("track_id", F.col("label").alias("label")).join(second.select("track_id", F.col("label").alias("again")), "track_id")
    return both.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("label") == F.col("again")).cast("long")).alias("agreed"))


def external_rates(incidents: DataFrame, borne_out: DataFrame) -> DataFrame:
    """Per detector: incidents, how many an external event bears out, and their share."""
    rows = incidents.select("incident_id", "detector").join(borne_out.select("incident_id").distinct().withColumn("hit", F.lit(1)), "incident_id", "left")
    return rows.groupBy("detector").agg(F.count("*").alias("n"), F.count("hit").alias("k")).withColumn("rate", F.round(F.col("k") / F.col("n"), 6))
