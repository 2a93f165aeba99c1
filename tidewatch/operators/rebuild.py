"""Clearing and building parts of stored tables anew."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewatch.sources.shared import removed


def replace_partitions(rows: DataFrame, path: str, *keys: str) -> None:
    """Writes rows to a table partitioned by keys; of the stored partitions only those that rows have are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def clear_partitions(rows: DataFrame, path: str, *keys: str, **values: str) -> None:
    """Replaces the partitions of values, also those for which rows have nothing: new partitions are written first, then
    stored ones that weren't replaced are removed. A failure between leaves old rows, never none; run it again then.

    Use it where a rebuild may find nothing at all; replace_partitions would leave the old rows.
    """
    spark = rows.sparkSession
    stale = spark.read.parquet(path)
    for name, value in values.items():
        stale = stale.where(stale[name] == value)
    gone = stale.select(*keys).distinct().join(rows.select(*keys).distinct(), list(keys), "left_anti").collect()  # partitions, not rows
    replace_partitions(rows, path, *keys)
    folder = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString  # escapes as the writer does
    removed(spark, *["/".join([path, *(folder(k, None if r[k] is None else str(r[k])) for k in keys)]) for r in gone])
