"""File sources: report CSVs, zipped CSVs, event pages and label files; all schemas are declared."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import parsing

REQUIRED = ("mmsi", "basedatetime", "lat", "lon")


def report_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, names in any case and a byte order mark or not; all fields as text."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return raw.toDF(*[c.lstrip("﻿").strip().lower() for c in raw.columns])


def positions(raw: DataFrame, region: str) -> DataFrame:
    """Reports of the rows that have vessel, time and place."""
    field = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    rows = raw.select(parsing.text(field("mmsi")).alias("mmsi"), parsing.timestamp(field("basedatetime")).alias("ts"), *[parsing.number(field(c)).alias(c) for c in ("lat", "lon", "sog", "cog", "heading")], parsing.text(field("status")).alias("nav_status"), F.lit(region).alias("region"))
    return rows.where("mmsi IS NOT NULL AND ts IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").withColumn("us", F.unix_micros("ts"))


def _origin(raw: DataFrame) -> list[Column]:
    """Where a row of a file source stands: file and block; nothing for other frames."""
    where = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]
    try:
        raw.select(*where)
    except AnalysisException:
        return []
    return where


def vessels(raw: DataFrame) -> DataFrame:
    """The vessel dimension, identity from a vessel's first row in the order of files by name and of rows in a file."""
    field = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    rows = raw.select(F.struct(*_origin(raw), F.monotonically_increasing_id()).alias("row"), parsing.text(field("mmsi")).alias("mmsi"), parsing.timestamp(field("basedatetime")).alias("ts"), parsing.text(field("vesselname")).alias("name"), parsing.text(field("callsign")).alias("call_sign"), parsing.ship_type(field("vesseltype")).alias("ship_type"), parsing.number(field("length")).alias("length"), parsing.number(field("width")).alias("width"))
    one = rows.where("mmsi IS NOT NULL AND ts IS NOT NULL").groupBy("mmsi").agg(F.min_by(F.struct("name", "call_sign", "ship_type", "length", "width"), "row").alias("v"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return one.select("mmsi", "v.*", parsing.flag(F.col("mmsi")).alias("flag"), "first_seen", "last_seen")


def zipped_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the one CSV in each ZIP, read in pieces by the executors."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in files:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    inner = [n for n in z.namelist() if n.lower().endswith(".csv")]
                    if len(inner) != 1:
                        raise ValueError(f"a ZIP must hold one CSV, not {len(inner)}")
                    with z.open(inner[0]) as f:  # unpacked as it is read
                        for part in pd.read_csv(f, dtype=str, chunksize=100_000, encoding="utf-8-sig"):
                            part.columns = [c.strip().lower() for c in part.columns]
                            yield part.reindex(columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def filtered(raw: DataFrame, south: float, west: float, north: float, east: float, mmsi: list[str] | None = None) -> DataFrame:
    """The rows of a report file inside a box, of some vessels if given; rows whose place can't be read go."""
    lat, lon = (parsing.number(F.col(c)) for c in ("lat", "lon"))
    rows = raw.where(lat.between(south, north) & lon.between(west, east))
    return rows if mmsi is None else rows.where(F.trim("mmsi").isin(*mmsi))


def digest(lines: DataFrame, value: str = "value") -> str:
    """A SHA-256 over the sorted SHA-256 of all lines, in two levels, so that no task holds a whole file."""
    line = lines.select(F.sha2(value, 256).alias("h"))
    parts = line.groupBy(F.substring("h", 1, 3).alias("k")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ""), 256)).first()[0]


def within(rows: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    return rows.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


# Event types of the provider and ours.
EVENT_TYPES = {"encounter": "rendezvous", "loitering": "loiter", "gap": "gap", "port_visit": "port-visit", "port-visit": "port-visit", "portvisit": "port-visit"}
_EVENT = "struct<id:string,type:string,start:string,end:string,position:struct<lat:double,lon:double>,vessel:struct<ssvid:string,mmsi:string>,encounter:struct<vessel:struct<ssvid:string>>>"


def event_pages(lines: DataFrame, value: str = "value") -> DataFrame:
    """External events of JSON pages (entries or data); unknown types go."""
    page = F.from_json(value, f"entries array<{_EVENT}>, data array<{_EVENT}>")
    rows = lines.select(page.alias("p")).select(F.explode(F.coalesce("p.entries", "p.data")).alias("e"))
    kinds = F.create_map(*[F.lit(x) for pair in EVENT_TYPES.items() for x in pair])
    when = lambda c: F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))
    return rows.select(F.col("e.id").alias("event_id"), F.try_element_at(kinds, F.lower("e.type")).alias("kind"), F.coalesce("e.vessel.ssvid", "e.vessel.mmsi").alias("mmsi"), F.col("e.encounter.vessel.ssvid").alias("counterpart_mmsi"), when("e.start").alias("ts_start"), when("e.end").alias("ts_end"), F.col("e.position.lat").alias("lat"), F.col("e.position.lon").alias("lon")).where("kind IS NOT NULL")


def report_log(lines: DataFrame, pattern: str = r"cycle took ([0-9.]+)s") -> DataFrame:
    """Seconds of the cycles that a log tells of."""
    return lines.select(F.regexp_extract("value", pattern, 1).try_cast("double").alias("seconds")).where("seconds IS NOT NULL")
