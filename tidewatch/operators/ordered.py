"""Exact order statistics over all rows without a window that gathers them in one task.

Rows are dealt to range partitions and written once. Each partition sums up its own rows; the
sums of the partitions, one row each, become offsets; a second pass adds the offset to a
running sum within the partition. No task holds more than a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.sources.shared import written


def running(rows: DataFrame, order: Sequence[str], sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """rows with, for each name of sums, the sum of its column over all rows that come before in the order.

    Rows that are equal in the order would have no place among each other: make the order unique first.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = {f"_{k}": v for k, v in sums.items()}
    dealt = written(rows.withColumns(given).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(*[F.sum(k).alias(k) for k in given])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    offsets = written(totals.select("_part", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_at") for k in given]))
    own = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.join(F.broadcast(offsets), "_part")
    return placed.select(*rows.columns, *[(F.col(f"_{k}_at") + F.coalesce(F.sum(f"_{k}").over(own), F.lit(0))).alias(k) for k in sums])


def numbered(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """rows with their place in a unique order, from 1."""
    return running(rows, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) + 1)


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """by, n and a column for each name of shares: exact quantiles of the values that aren't null, between ranks linearly.

    NaN counts as the largest value. Groups without a value have no row, an empty table gives none.
    Values are counted before they are ordered, so ties cost nothing; a group may be any share of all rows.
    """
    keys = list(by)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    if not keys:
        keys, counted = ["_all"], counted.withColumn("_all", F.lit(0))
    numbers = [f"_k{i}" for i in range(len(keys))]
    known = counted.withColumns({k: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for k, c in zip(numbers, keys, strict=True)})
    placed = written(running(known, [*numbers, "_v"], {"_before": F.col("_c")}))
    groups = placed.groupBy(*numbers).agg(F.min("_before").alias("_first"), F.sum("_c").alias("n"))
    wanted = groups.select("*", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in shares.items()])).alias("s"))
    spot = F.col("s.q") * (F.col("n") - 1)
    wanted = wanted.select(*numbers, "n", F.col("s.name").alias("_name"), spot.alias("_spot"), (F.col("_first") + F.floor(spot)).alias("_low"), (F.col("_first") + F.ceil(spot)).alias("_high"))
    inside = lambda at: (F.col(at) >= F.col("_before")) & (F.col(at) < F.col("_before") + F.col("_c"))
    # At most two values of a group and share pass; the groups' ranks are few numbers a group.
    met = placed.join(wanted, numbers).where(inside("_low") | inside("_high"))
    found = met.groupBy(*numbers, "_name", "n", "_spot").agg(*[F.first(F.col(c), ignorenulls=True).alias(c) for c in keys], F.max(F.when(inside("_low"), F.col("_v"))).alias("_a"), F.max(F.when(inside("_high"), F.col("_v"))).alias("_b"))
    below = F.floor("_spot")
    between = F.when(F.col("_spot") == below, F.col("_a")).when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((below + 1 - F.col("_spot")) * F.col("_a") + (F.col("_spot") - below) * F.col("_b"))
    found = found.withColumn("_q", between).groupBy(*numbers, "n").agg(*[F.first(F.col(c), ignorenulls=True).alias(c) for c in keys], *[F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in shares])
    return found.select(*by, "n", *shares)
