"""Joins of intervals: against a counted ledger by broadcast, against a large one by days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
LEDGER_ROWS = 100_000


def few(rows: DataFrame, most: int = LEDGER_ROWS) -> bool:
    """Whether rows may be broadcast; only up to one more than most are counted."""
    return rows.limit(most + 1).count() <= most


def days(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Each row once for every day that its interval touches, with the day."""
    return rows.withColumn("day", F.explode(F.sequence(F.floor(F.col(start) / DAY_US), F.floor(F.col(end) / DAY_US))))


def overlapping(rows: DataFrame, ledger: DataFrame, start: str, end: str, key: str, most: int = LEDGER_ROWS) -> DataFrame:
    """rows by the ledger's intervals (from_us, to_us; open-ended where null) that each shares time with; key names a row."""
    meets = (F.col("from_us") < F.col(end)) & (F.coalesce("to_us", F.lit(1 << 62)) > F.col(start))
    if few(ledger, most):
        return rows.join(F.broadcast(ledger), meets)
    last = rows.agg(F.max(end)).first()[0] or 0
    spans = ledger.withColumn("until", F.greatest("from_us", F.least(F.coalesce("to_us", F.lit(last)), F.lit(last)))).where(F.col("from_us") <= last)
    return days(rows, start, end).join(days(spans, "from_us", "until"), "day").where(meets).drop("day", "until").dropDuplicates([key, "from_us", "to_us"])
