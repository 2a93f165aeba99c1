"""Per-vessel risk from all incidents, and readable evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import zones
from tidewatch.functions.grading import clip1, credibility, grade_weight, risk_severity


def fuse(incidents: DataFrame) -> DataFrame:
    """One row per vessel: distinct detectors, techniques, partners and zones, scores, risk and representative point."""
    sets = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    techniques = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("techniques")))), ",")
    order = F.struct("score", "incident_id")
    rows = incidents.groupBy("mmsi").agg(
        F.count("*").alias("n_incidents"), F.count_distinct("detector").alias("n_detectors"), sets("detector").alias("detectors"), techniques.alias("techniques"), sets("counterpart_mmsi").alias("counterparts"), sets("zone_id").alias("zones"),
        F.max("score").alias("max_score"), F.min("reliability").alias("best_reliability"), F.max(zones.is_sensitive(F.col("zone_id")).cast("int")).alias("sensitive"),
        F.max_by("lat", order).alias("lat"), F.max_by("lon", order).alias("lon"), F.min("ts_start_us").alias("first_us"), F.max("ts_end_us").alias("last_us"),
    )
    diversity = 0.7 + 0.3 * clip1((F.col("n_detectors") - 1) / F.lit(3.0))
    base = F.col("max_score") * diversity * (0.6 + 0.4 * grade_weight(F.col("best_reliability")))
    rows = rows.withColumn("risk", F.round(F.least(F.lit(1.0), base + 0.1 * F.col("sensitive")), 4))
    return rows.withColumn("severity", risk_severity(F.col("risk")))


def evidence(incidents: DataFrame) -> DataFrame:
    """An evidence item with one sentence per incident."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    detail = (
        F.when(F.col("detector") == "gap", F.concat(F.lit("silent "), number("minutes"), F.lit(" min, back "), number("km"), F.lit(" km away")))
        .when(F.col("detector") == "rendezvous", F.concat(F.lit("with "), F.coalesce("counterpart_mmsi", F.lit("?")), F.lit(" for "), number("minutes"), F.lit(" min")))
        .when(F.col("detector") == "loiter", F.concat(F.lit("dwelling "), number("minutes"), F.lit(" min")))
        .otherwise(F.concat(F.lit("implied "), number("knots"), F.lit(" kn")))
    )
    where = F.when(F.col("zone_id").isNotNull(), F.concat(F.lit(" in "), "zone_id")).otherwise("")
    return incidents.select("incident_id", "mmsi", "detector", "severity", "reliability", credibility(F.col("score")).alias("credibility"), F.concat("incident_type", F.lit(": vessel "), "mmsi", where, F.lit("; "), detail).alias("summary"))


def ranked(incidents: DataFrame, limit: int = 200) -> DataFrame:
    """The incidents with the highest scores; equal ones by id."""
    return incidents.orderBy(F.desc("score"), "incident_id").limit(limit)
