"""Dropping reports that say nothing new, with the last accepted one as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.tracks import by_time

PARTS = 64  # of a vessel, that go to one task together
SECONDS, TURN, SPEED = 45.0, 20.0, 2.0


def news(last: tuple | None, now: tuple, seconds: float = SECONDS, turn: float = TURN, speed: float = SPEED) -> bool:
    """Whether a report (us, heading, sog, nav_status) differs enough from the last accepted one."""
    if last is None:
        return True
    differ = lambda a, b: not (pd.isna(a) or pd.isna(b))
    if (now[0] - last[0]) / 1e6 >= seconds or now[3] != last[3]:
        return True
    if differ(now[1], last[1]) and abs((now[1] - last[1] + 180) % 360 - 180) >= turn:
        return True
    return differ(now[2], last[2]) and abs(now[2] - last[2]) >= speed


def accepted(rows: pd.DataFrame, last: tuple | None, **limits: float) -> tuple[list[bool], tuple | None]:
    """Which rows pass, in their order, and the state after them."""
    keep = []
    for now in zip(rows["us"], rows["heading"], rows["sog"], rows["nav_status"], strict=True):
        keep.append(news(last, now, **limits))
        last = now if keep[-1] else last
    return keep, last


def downsampled(positions: DataFrame, **limits: float) -> DataFrame:
    """The reports that pass, vessel by vessel in the order of time.

    A report that comes seconds or more after the one before it passes whatever was accepted last, so a
    vessel's path is cut there. Reports between two cuts pass as they are; the others are gone through part by
    part, and a vessel's parts are dealt to many tasks.
    """
    quiet = limits.get("seconds", SECONDS) * 1e6
    cols = positions.select("id", "mmsi", "us", "heading", "sog", "nav_status")
    apart = lambda other: F.coalesce(F.abs(F.col("us") - other) >= quiet, F.lit(True))
    rows = cols.withColumns({"_cut": apart(F.lag("us").over(by_time())), "_end": apart(F.lead("us").over(by_time()))})
    rows = rows.withColumn("_part", F.sum(F.col("_cut").cast("long")).over(by_time()))
    alone = F.col("_cut") & F.col("_end")
    names = cols.columns
    several = rows.where(~alone).repartition("mmsi", F.expr(f"_part div {PARTS}")).sortWithinPartitions("mmsi", "us", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            keep = []
            for cut, *now in zip(batch["_cut"], batch["us"], batch["heading"], batch["sog"], batch["nav_status"], strict=True):
                keep.append(bool(cut) or news(last, now, **limits))
                last = now if keep[-1] else last
            yield batch.loc[keep, names]

    return rows.where(alone).select(*names).unionByName(several.select(*names, "_cut").mapInPandas(run, cols.schema))
