"""A stored index of slow vessels: a refresh of some vessels looks only at the days and cells that they were slow in.

Three tables of a store, all by vessel and day: the slow legs of each half hour, the cells that they
touch, and the ends of each vessel's path. They are brought up to date for dirty vessels
alone. Neighbours of dirty vessels are found by an equi-join on day, half hour and cell; only
the days that are asked for are scanned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import detect
from tidewatch.sources.shared import counted, written
from tidewatch.sources.store import Key, Spec, Store

RANGE_KM, SPEED_KN, TRANSIT_KN = 0.5, 1.0, 3.0
_LEGS = "mmsi string, id long, us long, lat double, lon double, v double, prev_us long, prev_lat double, prev_lon double, prev_v double, slow_from long, slow_to long, bin long, at_us long"
_CELLS = "mmsi string, bin long, cy long, cx long, s double, n double, at_us long"
_ENDS = "mmsi string, first_us long, last_us long, region string"


def specs(spark: SparkSession) -> dict[str, Spec]:
    shape = lambda ddl: spark.createDataFrame([], ddl).schema
    return {"legs": Spec(shape(_LEGS), ("mmsi", "us", "id", "bin"), time="at_us"), "cells": Spec(shape(_CELLS), ("mmsi", "bin", "cy", "cx"), time="at_us"), "ends": Spec(shape(_ENDS), ("mmsi",))}


def refreshed(store: Store, positions: DataFrame, dirty: DataFrame) -> dict[str, dict[Key, str | None]]:
    """Stages the index after dirty vessels (mmsi) were indexed again; positions hold all of these vessels' reports."""
    own = dirty.select("mmsi").distinct()
    p = positions.join(own, "mmsi", "left_semi")
    timed = lambda rows: rows.withColumn("at_us", F.col("bin") * detect.BIN_US)
    legs = written(timed(detect.slow_legs(p, SPEED_KN)))
    fresh = {"legs": legs, "cells": timed(detect.leg_cells(legs.drop("at_us"), RANGE_KM)), "ends": detect.under_way(p, TRANSIT_KN)}
    parts = sorted({part for _, part in store.keys("ends", own)})
    return {name: store.replace(name, rows, store.read(name, parts=parts).join(own, "mmsi", "left_semi")) for name, rows in fresh.items()}


def neighbours(store: Store, dirty: DataFrame) -> DataFrame:
    """(mmsi) of dirty vessels and of those that were slow in a half hour and cell with them."""
    own = dirty.select("mmsi").distinct()
    cells, moving = store.read("cells"), store.read("ends").select("mmsi")
    parts = sorted({part for _, part in store.keys("ends", own)})
    asked = written(store.read("cells", parts=parts).join(own, "mmsi", "left_semi").join(moving, "mmsi", "left_semi").drop("part"))
    return own.unionByName(met(cells, asked).join(moving, "mmsi", "left_semi").select("mmsi")).distinct()


def met(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """The cells that are among asked, by day, half hour and place; other days aren't scanned."""
    wanted = counted(written(asked.select("day", "bin", "cy", "cx").distinct()))
    days = [r["day"] for r in wanted.select("day").distinct().collect()]  # few numbers
    return cells.where(F.col("day").isin(days)).join(wanted, ["day", "bin", "cy", "cx"])


def moments(store: Store, dirty: DataFrame, minutes: float = 30, step_min: float = 5) -> DataFrame:
    """detect.near_moments(positions, focus=dirty) from the index."""
    hood = written(neighbours(store, dirty))
    parts = sorted({part for _, part in store.keys("ends", hood)})
    moving = store.read("ends").drop("day", "part")
    some = written(store.read("cells", parts=parts).join(hood, "mmsi", "left_semi").join(moving, "mmsi", "left_semi").drop("part"))
    others = met(store.read("cells"), some).join(moving, "mmsi", "left_semi")
    shared = detect.shared_bins(some, others, RANGE_KM, "day")
    legs = store.read("legs").drop("day", "part", "at_us")
    return detect.moments_of(shared, legs, moving, RANGE_KM, SPEED_KN, minutes, step_min)


def rendezvous(store: Store, dirty: DataFrame) -> DataFrame:
    """detect.rendezvous(positions, dirty) from the index."""
    return detect.rendezvous(None, dirty, moments(store, dirty))
