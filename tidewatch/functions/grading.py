"""Scores, confidences and texts of incidents as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _steps(value: Column, cuts: list[tuple[float, object]], rest: object) -> Column:
    out = F.lit(rest)
    for least, name in reversed(cuts):
        out = F.when(value >= least, F.lit(name)).otherwise(out)
    return out


# The cuts of grades, severities and credibilities.
def grade(confidence: Column) -> Column:
    return _steps(confidence, [(0.8, "B"), (0.6, "C"), (0.4, "D"), (0.2, "E")], "F")


def severity(score: Column) -> Column:
    return _steps(score, [(0.85, "critical"), (0.65, "high"), (0.4, "moderate")], "low")


def risk_severity(risk: Column) -> Column:
    return _steps(risk, [(0.8, "critical"), (0.6, "high"), (0.4, "moderate")], "low")


def credibility(score: Column) -> Column:
    return _steps(score, [(0.85, 2), (0.65, 3), (0.45, 4), (0.25, 5)], 6)


def grade_weight(name: Column) -> Column:
    out = F.lit(0.1)
    for letter, weight in (("A", 1.0), ("B", 0.8), ("C", 0.6), ("D", 0.4), ("E", 0.2)):
        out = F.when(name == letter, F.lit(weight)).otherwise(out)
    return out


def clip1(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the 95 % Wilson interval of k out of n; null where n is 0."""
    p, zz = k / n, z * z
    mid, half = p + zz / (2 * n), F.lit(z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    low, high = (mid - half) / (1 + zz / n), (mid + half) / (1 + zz / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), low)), F.when(n > 0, F.least(F.lit(1.0), high))


def anomaly_score(error: Column, threshold: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 * error / (threshold + 1e-12)))


# What a reason tells, in order, and its category.
def outage_category(reason: Column) -> Column:
    text = F.lower(reason)
    of_source = text.contains("timeout") | text.contains("connection")
    of_store = text.contains("persistence") | text.contains("database")
    return F.when(text.contains("offline"), "collector-offline").when(of_source, "source-connectivity").when(of_store, "local-storage").otherwise("coverage-unavailable")


def public_id(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 12)
