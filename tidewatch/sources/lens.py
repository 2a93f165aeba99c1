"""Position reports projected from the events table, for fixtures without AIS data.

Users become vessels and time runs 24 times as fast; integer arithmetic on the ids places
them around a strait: some drift, some lie at anchor, some keep close pairs, some teleport.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import parsing

EPOCH_US = 1_704_067_200_000_000
SPEEDUP = 24


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, mmsi, ts, us, lat, lon, sog, cog, heading, nav_status, source, region."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")
    rows = events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).withColumn("us", F.expr(f"{EPOCH_US} + ({us_sql()} - {EPOCH_US}) div {SPEEDUP}"))
    rows = rows.withColumn("slot", F.expr(f"(us - {EPOCH_US}) div 600000000")).withColumn("pair", F.expr("(user_id div 2) % 5 = 0"))
    rows = rows.withColumn("g", F.expr("case when pair then (user_id div 2) * 2 else user_id end"))
    return rows.selectExpr(
        "event_id as id", "'563' || lpad(cast(user_id as string), 6, '0') as mmsi", "timestamp_micros(us) as ts", "us",
        """cast(1.05 as double) + ((g * 17) % 200) / cast(1000 as double)
           + case when pair then ((event_id * 13) % 97) / cast(100000 as double) when g % 3 = 0 then ((event_id * 13) % 97) / cast(20000 as double)
                  else ((slot * (1 + g % 4) + g) % 160) / cast(1000 as double) end
           + case when event_id % 211 = 0 then cast(2.0 as double) else cast(0.0 as double) end as lat""",
        "cast(103.50 as double) + ((g * 29) % 500) / cast(1000 as double) + ((event_id * 31) % 89) / case when pair then cast(100000 as double) else cast(20000 as double) end as lon",
        """case when pair then case when event_id % 50 = 0 then cast(5.0 as double) else ((event_id * 7) % 9) / cast(10 as double) end
                when g % 3 = 0 then cast(0.5 as double) + ((event_id * 7) % 16) / cast(10 as double) else cast(4.0 as double) + event_id % 9 end as sog""",
        "cast((event_id * 37) % 360 as double) as cog", "cast((event_id * 37) % 360 as double) as heading", "cast(event_id % 4 as string) as nav_status", "'aisstream' as source", "'singapore' as region",
    )


def us_sql() -> str:
    return "unix_micros(cast(ts as timestamp))"


SQL = f"""
raw AS (SELECT event_id, user_id, {EPOCH_US} + (epoch_us(ts) - {EPOCH_US}) // {SPEEDUP} AS us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
placed AS (SELECT *, (us - {EPOCH_US}) // 600000000 AS slot, (user_id // 2) % 5 = 0 AS pair,
                  CASE WHEN (user_id // 2) % 5 = 0 THEN (user_id // 2) * 2 ELSE user_id END AS g FROM raw),
positions AS (
  SELECT event_id AS id, '563' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS mmsi, make_timestamp(us) AS ts, us,
         CAST(1.05 AS DOUBLE) + ((g * 17) % 200) / CAST(1000 AS DOUBLE)
           + CASE WHEN pair THEN ((event_id * 13) % 97) / CAST(100000 AS DOUBLE) WHEN g % 3 = 0 THEN ((event_id * 13) % 97) / CAST(20000 AS DOUBLE)
                  ELSE ((slot * (1 + g % 4) + g) % 160) / CAST(1000 AS DOUBLE) END
           + CASE WHEN event_id % 211 = 0 THEN CAST(2.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS lat,
         CAST(103.50 AS DOUBLE) + ((g * 29) % 500) / CAST(1000 AS DOUBLE) + ((event_id * 31) % 89) / CASE WHEN pair THEN CAST(100000 AS DOUBLE) ELSE CAST(20000 AS DOUBLE) END AS lon,
         CASE WHEN pair THEN CASE WHEN event_id % 50 = 0 THEN CAST(5.0 AS DOUBLE) ELSE ((event_id * 7) % 9) / CAST(10 AS DOUBLE) END
              WHEN g % 3 = 0 THEN CAST(0.5 AS DOUBLE) + ((event_id * 7) % 16) / CAST(10 AS DOUBLE) ELSE CAST(4.0 AS DOUBLE) + event_id % 9 END AS sog,
         CAST((event_id * 37) % 360 AS DOUBLE) AS heading, CAST(event_id % 4 AS VARCHAR) AS nav_status, 'aisstream' AS source, 'singapore' AS region
  FROM placed)
"""


def vessels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mmsi, name, ship_type, flag of every vessel with a position; type codes follow from the user's number."""
    rows = positions(spark, sf_dir).select("mmsi").distinct().withColumn("user", F.substring("mmsi", 4, 6).cast("long"))
    code = (F.lit(28) + (F.col("user") * 7) % 65).cast("string")
    return rows.select("mmsi", F.concat(F.lit("VESSEL "), F.col("user").cast("string")).alias("name"), parsing.ship_type(code).alias("ship_type"), parsing.flag(F.col("mmsi")).alias("flag"))


VESSELS_SQL = """vessels AS (SELECT mmsi, 'VESSEL ' || u AS name, CASE WHEN c = 30 THEN 'fishing' WHEN c BETWEEN 31 AND 39 THEN 'special' WHEN c BETWEEN 60 AND 69 THEN 'passenger' WHEN c BETWEEN 70 AND 79 THEN 'cargo' WHEN c BETWEEN 80 AND 89 THEN 'tanker' WHEN c = 52 THEN 'tug' ELSE 'other' END AS ship_type, 'SG' AS flag
  FROM (SELECT mmsi, u, 28 + (u * 7) % 65 AS c FROM (SELECT DISTINCT mmsi, CAST(substring(mmsi, 4, 6) AS BIGINT) AS u FROM positions)))"""
