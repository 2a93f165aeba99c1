"""The live lane: message parsing, stateful downsampling and micro-batch upkeep with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.functions import parsing
from tidewatch.operators.downsample import accepted

HOUR_US = 3_600_000_000
_REPORT = "struct<Sog:double,Cog:double,TrueHeading:double,NavigationalStatus:string>"
MESSAGE = f"""MessageType string, MetaData struct<MMSI:bigint,ShipName:string,latitude:double,longitude:double,time_utc:string>,
Message struct<PositionReport:{_REPORT},StandardClassBPositionReport:{_REPORT},
ShipStaticData:struct<Name:string,CallSign:string,Type:int,Dimension:struct<A:int,B:int,C:int,D:int>>>"""


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Messages by field; lines that are no message of a vessel go."""
    return lines.select(F.from_json(value, MESSAGE).alias("m")).where("m.MetaData.MMSI IS NOT NULL").select("m.*")


def reports(messages: DataFrame) -> DataFrame:
    """Position reports with sentinels and impossible coordinates removed."""
    r = F.coalesce("Message.PositionReport", "Message.StandardClassBPositionReport")
    rows = messages.where(F.col("MessageType").isin("PositionReport", "StandardClassBPositionReport")).select(
        F.col("MetaData.MMSI").cast("string").alias("mmsi"), parsing.live_timestamp(F.col("MetaData.time_utc")).alias("ts"), parsing.coordinate(F.col("MetaData.latitude"), -90, 90).alias("lat"), parsing.coordinate(F.col("MetaData.longitude"), -180, 180).alias("lon"),
        parsing.below(r["Sog"], 102.3).alias("sog"), parsing.below(r["Cog"], 360).alias("cog"), parsing.below(r["TrueHeading"], 360).alias("heading"), r["NavigationalStatus"].alias("nav_status"),
    )
    return rows.where("ts IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").withColumn("us", F.unix_micros("ts"))


def identities(messages: DataFrame) -> DataFrame:
    """Static data of vessels: names, categories and sizes; a size of 0 is unknown."""
    s, m = F.col("Message.ShipStaticData"), F.col("MetaData")
    total = lambda a, b: F.nullif(F.coalesce(s["Dimension"][a], F.lit(0)) + F.coalesce(s["Dimension"][b], F.lit(0)), F.lit(0))
    mmsi = m["MMSI"].cast("string")
    return messages.select(mmsi.alias("mmsi"), F.coalesce(parsing.text(s["Name"]), parsing.text(m["ShipName"])).alias("name"), parsing.text(s["CallSign"]).alias("call_sign"), parsing.ship_type(s["Type"].cast("string")).alias("ship_type"), parsing.flag(mmsi).alias("flag"), total("A", "B").cast("double").alias("length"), total("C", "D").cast("double").alias("width"))


def downsample_stream(rows: DataFrame, **limits: float) -> DataFrame:
    """Per vessel, the reports that say something new; the state is the last accepted report, in order of arrival."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        for part in parts:
            keep, last = accepted(part, last, **limits)
            yield part[keep][["mmsi", "us", "heading", "sog", "nav_status"]]
        if last is not None:
            state.update((int(last[0]), None if pd.isna(last[1]) else float(last[1]), None if pd.isna(last[2]) else float(last[2]), last[3]))

    cols = rows.select("mmsi", "us", "heading", "sog", "nav_status")
    return cols.groupBy("mmsi").applyInPandasWithState(step, "mmsi string, us long, heading double, sog double, nav_status string", "us long, heading double, sog double, nav_status string", "append", GroupStateTimeout.NoTimeout)


def start(stream: DataFrame, upkeep: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs upkeep once for each micro-batch; replay after a failure repeats a batch under its number."""
    return stream.writeStream.foreachBatch(upkeep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outages(messages: DataFrame, silence_s: int = 90) -> DataFrame:
    """(key, opened_us, closed_us): silences of a feed beyond silence_s, opened when the feed should have spoken.

    A feed's messages are ordered hour by hour, and only each hour's first and last one meet in one place.
    """
    rows = messages.select("key", "us").distinct().withColumn("hour", F.floor(F.col("us") / HOUR_US))
    inside = rows.withColumn("before", F.lag("us").over(W.partitionBy("key", "hour").orderBy("us"))).where("before IS NOT NULL")
    ends = rows.groupBy("key", "hour").agg(F.min("us").alias("us"), F.max("us").alias("last"))
    across = ends.withColumn("before", F.lag("last").over(W.partitionBy("key").orderBy("hour"))).where("before IS NOT NULL")
    every = inside.select("key", "us", "before").unionByName(across.select("key", "us", "before"))
    return every.where(F.col("us") - F.col("before") > silence_s * 1_000_000).select("key", (F.col("before") + silence_s * 1_000_000).alias("opened_us"), F.col("us").alias("closed_us"))
