"""Detectors: reporting gaps, implausible kinematics, loitering, meetings; coverage and incidents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.functions import zones
from tidewatch.functions.geo import EARTH_KM, haversine_km, short_way, to_180
from tidewatch.functions.grading import clip1, grade, severity
from tidewatch.operators import dwelling
from tidewatch.operators.overlap import overlapping
from tidewatch.operators.tracks import by_time, steps
from tidewatch.sources.shared import counted, settled, sliced, slices, written

HOUR_US, BIN_US = 3_600_000_000, 1_800_000_000
CELL = 0.25
FINE, FINE_CELLS = 0.01, 4_096  # degrees of a cell in the search for meetings; boxes that need more of them are sought in cells of CELL degrees
AHEAD = (3, 12)
SLICE_LEGS = 500_000
SLICE_PAIRS, MOST_BINS = 2_000_000, 64  # pairs of vessels in a cell and half hour that a slice of near_moments() may hold, and the most slices
SAMPLES = 12
# Names, kinds, techniques and thresholds of findings, below and in the detectors, are those of the data model.
COLUMNS = ("incident_id", "mmsi", "detector", "incident_type", "score", "severity", "reliability", "confidence", "ts_start_us", "ts_end_us", "lat", "lon", "zone_id", "counterpart_mmsi", "techniques", "minutes", "km", "knots", "region", "evidence")
#: What findings rest on; a detector fills its own fields.
EVIDENCE = {
    "gap_minutes": "double", "displacement_km": "double", "implied_speed_kn": "double", "jump_km": "double", "interval_s": "double", "physical_ceiling_kn": "double", "duration_minutes": "double",
    "radius_km": "double", "mean_speed_kn": "double", "points": "long", "min_range_km": "double", "counterpart": "string", "reconstruction_error": "double", "threshold": "double",
    "coverage_verdict": "string", "corridor_support": "double", "corridor_samples": "int", "corridor_witnessed": "int", "witness_vessels": "int", "endpoint_witnessed": "int", "caveat": "string",
}


def incidents(rows: DataFrame, detector: str, kind: Column, techniques: Column, counterpart: Column | None = None, evidence: dict[str, Column] | None = None) -> DataFrame:
    """The shared shape of findings; rows bring mmsi, score, confidence, ts_start_us, ts_end_us, lat, lon, minutes, km, knots, region.

    The zone is the point's; a sensitive one adds 0.1 to the confidence, up to 1. Evidence
    has a field for everything in EVIDENCE, null where the detector gives none, and the zone's name.
    """
    rows = rows.withColumn("zone_id", zones.zone_of(F.col("lat"), F.col("lon")))
    confidence = F.least(F.lit(1.0), F.col("confidence") + F.when(zones.is_sensitive(F.col("zone_id")), 0.1).otherwise(0.0))
    partner = F.lit(None).cast("string") if counterpart is None else counterpart
    second = F.floor(F.col("ts_start_us") / 1_000_000).cast("long").cast("string")
    given = evidence or {}
    held = F.struct(*[given.get(name, F.lit(None)).cast(kind_).alias(name) for name, kind_ in EVIDENCE.items()], zones.name_of(F.col("zone_id")).alias("zone"))
    rows = rows.withColumns({"evidence": held, "confidence": F.round(confidence, 4), "score": F.round("score", 4), "counterpart_mmsi": partner, "detector": F.lit(detector), "incident_type": kind, "techniques": techniques})
    return rows.withColumns({"severity": severity(F.col("score")), "reliability": grade(F.col("confidence")), "incident_id": F.substring(F.concat_ws("-", "detector", "mmsi", "counterpart_mmsi", second), 1, 96)}).select(*COLUMNS)


# -- gaps and coverage ------------------------------------------------------------------


def gap_segments(positions: DataFrame, outages: DataFrame | None = None, minutes: float = 120, km: float = 5) -> DataFrame:
    """Silences of at least minutes in which a vessel moved at least km, less those that an outage overlaps.

    Outages are (opened_us, closed_us), open-ended where null; silences are written before these are looked at, so that reports
    are sorted once, and only with what a silence needs.
    """
    needed = [c for c in ("id", "mmsi", "us", "lat", "lon", "region") if c in positions.columns]
    rows = steps(positions.select(*needed)).where((F.col("seconds") >= minutes * 60) & (F.col("km") >= km))
    if outages is None:
        return rows
    rows = written(rows)
    hidden = overlapping(rows.select("id", "prev_us", "us"), outages.select(F.col("opened_us").alias("from_us"), F.col("closed_us").alias("to_us")), "prev_us", "us", "id")
    return rows.join(hidden.select("id"), "id", "left_anti").select(*rows.columns)


def witness_index(positions: DataFrame) -> DataFrame:
    """The distinct vessels heard in each cell and hour."""
    return positions.select(F.floor(F.col("lat") / CELL).alias("cell_lat"), F.floor(F.col("lon") / CELL).alias("cell_lon"), F.floor(F.col("us") / HOUR_US).alias("hour"), "mmsi").distinct()


def vessel_numbers(positions: DataFrame) -> DataFrame:
    """(mmsi, number): every vessel's number, written once. Vessels first heard near each other have numbers near each other, so
    that those of one cell share few words of 64 bits."""
    cells = [F.floor(F.col(c) / CELL).alias(c) for c in ("lat", "lon")]
    homes = positions.groupBy("mmsi").agg(F.min(F.struct("us", *cells)).alias("home")).select("mmsi", F.col("home.lat").alias("y"), F.col("home.lon").alias("x"))
    parts = int(positions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(homes.repartitionByRange(parts, "y", "x", "mmsi").sortWithinPartitions("y", "x", "mmsi").select("mmsi", F.monotonically_increasing_id().alias("number")))


def witness_words(positions: DataFrame, numbers: DataFrame) -> DataFrame:
    """(cell_lat, cell_lon, hour, word, bits): who was heard in each cell and hour, 64 vessels a row."""
    rows = positions.select("mmsi", F.floor(F.col("lat") / CELL).alias("cell_lat"), F.floor(F.col("lon") / CELL).alias("cell_lon"), F.floor(F.col("us") / HOUR_US).alias("hour")).join(numbers, "mmsi")
    return rows.groupBy("cell_lat", "cell_lon", "hour", F.expr("number div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(number % 64 as int))")).alias("bits"))


def coverage(segments: DataFrame, positions: DataFrame) -> DataFrame:
    """segments with support, witnessed, witnesses, ends and verdict: who else was heard along the silent corridor.

    Twelve points along the straight line, all hours touched; a point counts with two other
    vessels. Silences of the same cells and hours share a corridor, which is looked at once: bitmaps of vessels by cell and hour
    are united by OR for each of its cells, then for all of them, and counted in their bits; the vessel itself is taken off where it was heard
    there. So work grows with the corridors, which are bounded by the sea and the hours, times the vessels' words.
    """
    segments = written(segments)
    floor = lambda c, k: F.floor((F.col(f"prev_{c}") + (F.col(c) - F.col(f"prev_{c}")) * (k / (SAMPLES - 1))) / CELL)
    ways = segments.select("id", "mmsi", F.array(*[F.struct(floor("lat", k).alias("y"), floor("lon", k).alias("x")) for k in range(SAMPLES)]).alias("at"), F.floor(F.col("prev_us") / HOUR_US).alias("h0"), F.floor(F.col("us") / HOUR_US).alias("h1"))
    ways = ways.withColumn("path", F.array_sort(F.array_distinct("at")))
    corridors = written(ways.select("path", "h0", "h1").distinct().withColumn("corridor", F.monotonically_increasing_id()))
    parts = corridors.select("corridor", "h0", "h1", F.explode("path").alias("c")).select("corridor", "h0", "h1", "c.y", "c.x")
    stays = written(parts.select("y", "x", "h0", "h1").distinct().withColumn("stay", F.monotonically_increasing_id()))
    hours = F.explode(F.sequence("h0", "h1")).alias("hour")
    words = witness_words(positions, counted(vessel_numbers(positions))).withColumnsRenamed({"cell_lat": "y", "cell_lon": "x"})
    held = written(stays.select("stay", "y", "x", hours).join(words, ["y", "x", "hour"]).groupBy("stay", "word").agg(F.bit_or("bits").alias("bits")))
    in_cell = held.groupBy("stay").agg(F.sum(F.bit_count("bits")).alias("heard"))
    in_all = parts.join(stays, ["y", "x", "h0", "h1"]).select("corridor", "stay").join(held, "stay").groupBy("corridor", "word").agg(F.bit_or("bits").alias("bits")).groupBy("corridor").agg(F.sum(F.bit_count("bits")).alias("every"))
    asked = ways.select("id", "mmsi", F.explode("path").alias("c"), "h0", "h1").select("id", "mmsi", "c", "c.y", "c.x", hours)
    seen = positions.select("mmsi", F.floor(F.col("lat") / CELL).alias("y"), F.floor(F.col("lon") / CELL).alias("x"), F.floor(F.col("us") / HOUR_US).alias("hour"))
    own = asked.join(seen, ["mmsi", "y", "x", "hour"], "left_semi").groupBy("id").agg(F.collect_set("c").alias("own"))  # at most as many as samples
    ways = written(ways.join(own, "id", "left").join(corridors, ["path", "h0", "h1"]).join(in_all, "corridor", "left").drop("path", "corridor"))
    spots = ways.select("id", "own", "h0", "h1", F.posexplode("at").alias("k", "c")).select("*", "c.y", "c.x").join(stays.join(in_cell, "stay"), ["y", "x", "h0", "h1"], "left")
    others = F.coalesce("heard", F.lit(0)) - F.coalesce(F.array_contains("own", F.col("c")), F.lit(False)).cast("long")
    enough = lambda on: F.sum((on & (others >= 2)).cast("long"))
    points = spots.groupBy("id").agg(enough(F.lit(True)).alias("witnessed"), enough(F.col("k").isin(0, SAMPLES - 1)).alias("ends"))
    total = ways.select("id", (F.coalesce("every", F.lit(0)) - F.col("own").isNotNull().cast("long")).cast("long").alias("witnesses"))
    rows = segments.join(total.join(points, "id"), "id", "left").fillna(0, ["witnessed", "witnesses", "ends"])
    rows = rows.withColumn("support", F.col("witnessed") / F.lit(float(SAMPLES)))
    return rows.withColumn("verdict", F.when(F.col("support") >= 0.75, "vessel-attributed").when(F.col("support") >= 0.25, "partial").otherwise("coverage-explained"))


def gaps(positions: DataFrame, outages: DataFrame | None = None, whole: DataFrame | None = None) -> DataFrame:
    """Incidents of vessels going dark; whole is the population that may witness, where positions is a part of it."""
    rows = coverage(gap_segments(positions, outages), positions if whole is None else whole)
    minutes = F.col("seconds") / 60
    sensitive = zones.is_sensitive(zones.zone_of(F.col("prev_lat"), F.col("prev_lon")))
    factor = F.when(F.col("verdict") == "vessel-attributed", 1.6).when(F.col("verdict") == "partial", 1.0).otherwise(0.5)
    rows = rows.withColumns({
        "score": F.lit(0.4) + 0.3 * clip1(minutes / 360) + 0.3 * clip1(F.col("km") / 25), "confidence": F.least(F.lit(1.0), (F.lit(0.35) + F.when(sensitive, 0.15).otherwise(0.0)) * factor),
        "ts_start_us": F.col("prev_us"), "ts_end_us": F.col("us"), "minutes": F.round(minutes, 1), "km": F.round("km", 2), "knots": F.round("knots", 1), "lat": F.col("prev_lat"), "lon": F.col("prev_lon"),
    })
    held = {
        "gap_minutes": F.col("minutes"), "displacement_km": F.col("km"), "implied_speed_kn": F.col("knots"), "coverage_verdict": F.col("verdict"), "corridor_support": F.round("support", 3), "corridor_samples": F.lit(SAMPLES),
        "corridor_witnessed": F.col("witnessed"), "witness_vessels": F.col("witnesses"), "endpoint_witnessed": F.col("ends"), "caveat": F.lit("silence may come from lost coverage"),
    }
    return incidents(rows, "gap", F.lit("dark ship (AIS gap)"), F.array(F.lit("ais-gap"), F.lit("going-dark")), evidence=held)


# -- kinematics -------------------------------------------------------------------------


def spoofs(positions: DataFrame, ceiling_kn: float = 60) -> DataFrame:
    """Incidents of reports that imply more than ceiling_kn."""
    rows = steps(positions).where(F.col("knots") > ceiling_kn)
    rows = rows.withColumns({
        "score": F.least(F.lit(1.0), F.lit(0.7) + F.col("knots") / 1200), "confidence": F.lit(0.85), "ts_start_us": F.col("us"), "ts_end_us": F.col("us"),
        "minutes": F.round(F.col("seconds") / 60, 1), "km": F.round("km", 1), "knots": F.round("knots", 1),
    })
    kind = F.when(F.col("seconds") < 60, "duplicate identity").otherwise("impossible kinematics")
    held = {"implied_speed_kn": F.col("knots"), "jump_km": F.col("km"), "interval_s": F.round("seconds", 1), "physical_ceiling_kn": F.lit(float(ceiling_kn)), "caveat": F.lit("two vessels may share one identity by mistake")}
    return incidents(rows, "spoof", kind, F.array(F.lit("ais-spoof"), F.lit("impossible-kinematics")), evidence=held)


# -- loitering --------------------------------------------------------------------------


def in_port(lat: float, lon: float) -> bool:
    def holds(ring: list[tuple[float, float]]) -> bool:
        odd = False
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True):
            odd ^= ((a > lat) != (c > lat)) and lon < (d - b) * (lat - a) / (c - a) + b
        return odd

    return any(z[1] == "port" and holds(z[3]) for z in zones.ZONES)


def pieces(positions: DataFrame, radius_km: float = 2) -> DataFrame:
    """positions with piece, counted per vessel: a step of more than twice the radius begins another, since no span can hold both its ends."""
    rows = positions.withColumns({f"prev_{c}": F.lag(c).over(by_time()) for c in ("lat", "lon")})
    far = F.coalesce(haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon")) > 2 * radius_km, F.lit(False))
    return rows.withColumn("piece", F.sum(far.cast("long")).over(by_time())).drop("prev_lat", "prev_lon")


def loiters(positions: DataFrame, radius_km: float = 2, minutes: float = 60) -> DataFrame:
    """Incidents of dwelling. The greedy scan depends on order, so a vessel's reports meet sorted in a task, where the
    pieces of many paths are scanned at once; time grows with the reports, also of vessels that never leave."""
    cols = ["mmsi", "ts_start_us", "ts_end_us", "lat", "lon", "knots", "points", "region"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in dwelling.whole_paths(batches, ["mmsi", "piece"]):
            us, (lat, lon, sog) = rows["us"].to_numpy(), (rows[c].to_numpy(float) for c in ("lat", "lon", "sog"))
            end = dwelling.path_ends([rows["mmsi"].to_numpy(), rows["piece"].to_numpy()])
            spans = [s for s in dwelling.dwell_spans(us, lat, lon, sog, in_port, radius_km, minutes, end=end) if not s[5]]
            yield pd.DataFrame([(rows["mmsi"].iat[a], us[a], us[b], y, x, v, b - a + 1, rows["region"].iat[a]) for a, b, y, x, v, _ in spans], columns=cols)

    cut = pieces(positions.select("id", "mmsi", "us", "lat", "lon", "sog", "region"), radius_km).sortWithinPartitions("mmsi", "us", "id")
    found = cut.select("mmsi", "piece", "us", "lat", "lon", "sog", "region").mapInPandas(run, "mmsi string, ts_start_us long, ts_end_us long, lat double, lon double, knots double, points long, region string")
    minutes_ = (F.col("ts_end_us") - F.col("ts_start_us")) / F.lit(60e6)
    zone = zones.zone_of(F.col("lat"), F.col("lon"))
    extra = F.when(zones.is_sensitive(zone), 0.2).otherwise(0.0)
    found = found.withColumns({"score": clip1(F.lit(0.4) + 0.3 * clip1(minutes_ / 180) + extra), "confidence": F.lit(0.5) + extra, "minutes": F.round(minutes_, 1), "km": F.lit(float(radius_km)), "knots": F.round("knots", 2)})
    base = F.array(F.lit("loitering"))
    held = {"duration_minutes": F.col("minutes"), "radius_km": F.col("km"), "mean_speed_kn": F.col("knots"), "points": F.col("points"), "caveat": F.lit("waiting for a berth looks the same")}
    return incidents(found, "loiter", F.when(zone.isNotNull(), "zone incursion / loitering").otherwise("loitering"), F.when(zone.isNotNull(), F.concat(base, F.array(F.lit("zone-incursion")))).otherwise(base), evidence=held)


# -- meetings ---------------------------------------------------------------------------


def under_way(positions: DataFrame, transit_kn: float) -> DataFrame:
    """Vessels of at least two reports that were seen under way, with the ends of their paths."""
    order = F.struct("us", "id")
    rows = positions.groupBy("mmsi").agg(F.max(F.coalesce("sog", F.lit(0.0))).alias("top"), F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min_by("region", order).alias("region"))
    return rows.where((F.col("top") >= transit_kn) & (F.col("n") >= 2)).drop("top", "n")


def slow_legs(positions: DataFrame, speed_kn: float) -> DataFrame:
    """Legs between consecutive reports, and a vessel's first report as one of a microsecond, by the
    half hours in which the interpolated speed is at most speed_kn; slow_from and slow_to bound that part."""
    rows = positions.select("mmsi", "id", "us", "lat", "lon", F.coalesce("sog", F.lit(0.0)).alias("v"))
    rows = rows.withColumns({f"prev_{c}": F.coalesce(F.lag(c).over(by_time()), F.col(c) - 1 if c == "us" else F.col(c)) for c in ("us", "lat", "lon", "v")})
    rows = rows.where((F.col("us") > F.col("prev_us")) & (F.least("v", "prev_v") <= speed_kn)).withColumn("lon", F.col("prev_lon") + short_way(F.col("lon") - F.col("prev_lon")))
    share = lambda fast, slow: (F.col(fast) - speed_kn) / (F.col(fast) - F.col(slow))
    span = F.col("us") - F.col("prev_us")
    rows = rows.withColumns({
        "slow_from": F.when(F.col("prev_v") <= speed_kn, F.col("prev_us")).otherwise(F.col("prev_us") + F.greatest(F.lit(0), F.floor(span * share("prev_v", "v")) - 1)),
        "slow_to": F.when(F.col("v") <= speed_kn, F.col("us")).otherwise(F.col("us") - F.greatest(F.lit(0), F.floor(span * share("v", "prev_v")) - 1)),
    })
    return rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("slow_from") / BIN_US), F.floor(F.col("slow_to") / BIN_US))))


def _at(c: str, us: Column, side: str = "") -> Column:
    now, before = (lambda x: F.col(f"{side}{x}")), (lambda x: F.col(f"{side}prev_{x}"))
    return before(c) + (now(c) - before(c)) * ((us - before("us")) / (now("us") - before("us")))


def _boxes(legs: DataFrame) -> DataFrame:
    """legs with min_lat, max_lat, min_lon, max_lon: the box of the slow part that lies in each half hour."""
    lo, hi = F.greatest("slow_from", F.col("bin") * BIN_US), F.least("slow_to", (F.col("bin") + 1) * BIN_US)
    return legs.withColumns({f"{f}_{c}": (F.least if f == "min" else F.greatest)(_at(c, lo), _at(c, hi)) for c in ("lat", "lon") for f in ("min", "max")})


def _extent(pad: float, size: float) -> tuple[Column, Column, list[Column], list[Column]]:
    """Of a box widened by pad degrees: whether its cells go all around, their number, and the first and last ones in latitude and longitude."""
    pole = F.greatest(F.abs("min_lat"), F.abs("max_lat")) + pad
    wide = F.lit(pad) / F.cos(F.radians(pole))
    around = (pole >= 89) | (F.col("max_lon") - F.col("min_lon") + 2 * wide >= 360)
    y, x = [F.floor((F.col("min_lat") - pad) / size), F.floor((F.col("max_lat") + pad) / size)], [F.floor((F.col("min_lon") - wide) / size), F.floor((F.col("max_lon") + wide) / size)]
    return around, (y[1] - y[0] + 1) * F.when(around, F.lit(round(360 / size))).otherwise(x[1] - x[0] + 1), y, x


def _touched(boxes: DataFrame, pad: float, size: float) -> DataFrame:
    """boxes once for each cell (cy, cx) that they touch, widened by pad degrees."""
    around, _, y, x = _extent(pad, size)
    n = round(360 / size)
    columns = F.when(around, F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).otherwise(F.sequence(*x))
    return boxes.withColumn("cy", F.explode(F.sequence(*y))).withColumn("cx", F.explode(columns)).withColumn("cx", F.pmod("cx", F.lit(n)))


def leg_cells(legs: DataFrame, range_km: float) -> DataFrame:
    """(mmsi, bin, cy, cx, s, n): the cells that the slow parts of a vessel's legs touch in each half hour, widened by the range, and their latitudes.

    Cells go all around the globe near a pole and lie on both sides of the 180th meridian.
    """
    return _touched(_boxes(legs), _pad(range_km), CELL).groupBy("mmsi", "bin", "cy", "cx").agg(F.min("min_lat").alias("s"), F.max("max_lat").alias("n"))


def _pad(range_km: float) -> float:
    return float(np.degrees(range_km / EARTH_KM)) * 1.01


def shared_bins(some: DataFrame, others: DataFrame, range_km: float, *same: str) -> DataFrame:
    """(a, b, bin), a before b: the half hours in which a vessel of some and one of others share a cell and latitudes; same names further columns to be equal."""
    left, right, pad = some.alias("l"), others.alias("r"), _pad(range_km)
    on = F.col("l.mmsi") != F.col("r.mmsi")
    for c in ("bin", "cy", "cx", *same):
        on = on & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    near = (F.col("l.s") - 2 * pad <= F.col("r.n")) & (F.col("r.s") - 2 * pad <= F.col("l.n"))
    return left.join(right, on & near).select(F.least("l.mmsi", "r.mmsi").alias("a"), F.greatest("l.mmsi", "r.mmsi").alias("b"), F.col("l.bin").alias("bin")).distinct()


def _shared_bins(positions: DataFrame, legs: DataFrame, range_km: float, transit_kn: float) -> DataFrame:
    """The half hours in which two vessels that were seen under way may have been slow and near, each pair once."""
    return _pairs_of(leg_cells(legs.join(under_way(positions, transit_kn).select("mmsi"), "mmsi", "left_semi"), range_km), range_km)


def _pairs_of(cells: DataFrame, range_km: float) -> DataFrame:
    left, right, pad = cells.alias("l"), cells.alias("r"), _pad(range_km)
    near = (F.col("l.s") - 2 * pad <= F.col("r.n")) & (F.col("r.s") - 2 * pad <= F.col("l.n"))
    return left.join(right, (F.col("l.bin") == F.col("r.bin")) & (F.col("l.cy") == F.col("r.cy")) & (F.col("l.cx") == F.col("r.cx")) & (F.col("l.mmsi") < F.col("r.mmsi")) & near).select(F.col("l.mmsi").alias("a"), F.col("r.mmsi").alias("b"), F.col("l.bin").alias("bin")).distinct()


def meeting_candidates(positions: DataFrame, range_km: float = 0.5, speed_kn: float = 1.0, transit_kn: float = 3.0) -> DataFrame:
    """(a, b): pairs of vessels that may have been slow and near at the same time. A pair that truly met always does; only vessels seen under way take part."""
    return _shared_bins(positions, slow_legs(positions, speed_kn), range_km, transit_kn).select("a", "b").distinct()


def near_moments(positions: DataFrame, range_km: float = 0.5, speed_kn: float = 1.0, minutes: float = 30, step_min: float = 5, transit_kn: float = 3.0, focus: DataFrame | None = None) -> DataFrame:
    """(a, b, k, us, lat, lon, km, region): times of a pair's grid at which both interpolated paths are slow and near.

    A pair's grid runs from when both are known, in steps of step_min. Only grid times in the
    half hours that two vessels share are looked at, and only legs of those half hours; a
    vessel's whole path never travels. With focus (mmsi), only pairs of these vessels and
    of the vessels that they share a half hour with are kept. Moments of one half hour need no other: without
    focus many pairs are looked at in slices of the half hours, of which only the moments remain.
    """
    legs = written(slow_legs(positions, speed_kn))
    if focus is None:
        ends = written(under_way(positions, transit_kn))
        cells = written(leg_cells(legs.join(ends.select("mmsi"), "mmsi", "left_semi"), range_km))
        pairs = cells.groupBy("bin", "cy", "cx").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
        n = max(1, min(MOST_BINS, -(-pairs // SLICE_PAIRS)))

        def part(k: int) -> DataFrame:
            own = lambda rows: rows.where(F.pmod("bin", F.lit(n)) == k)
            return moments_of(_pairs_of(own(cells), range_km), own(legs), ends, range_km, speed_kn, minutes, step_min)

        return part(0) if n == 1 else reduce(DataFrame.unionByName, [settled(positions.sparkSession, lambda k=k: part(k)) for k in range(n)])
    shared = _shared_bins(positions, legs, range_km, transit_kn)
    if focus is not None:
        wanted = focus.select("mmsi").distinct()
        near = shared.join(wanted.withColumnRenamed("mmsi", "a"), "a", "left_semi").select(F.col("b").alias("mmsi")).union(shared.join(wanted.withColumnRenamed("mmsi", "b"), "b", "left_semi").select("a"))
        hood = wanted.union(near).distinct()
        shared = shared.join(hood.withColumnRenamed("mmsi", "a"), "a", "left_semi").unionByName(shared.join(hood.withColumnRenamed("mmsi", "b"), "b", "left_semi")).distinct()
    return moments_of(shared, legs, under_way(positions, transit_kn), range_km, speed_kn, minutes, step_min)


def moments_of(shared: DataFrame, legs: DataFrame, ends: DataFrame, range_km: float = 0.5, speed_kn: float = 1.0, minutes: float = 30, step_min: float = 5) -> DataFrame:
    """The near moments of pairs (a, b, bin) from slow_legs() and under_way() of their vessels, with their half hour.

    What travels is a pair's half hour with a leg of each; its grid times are counted out when both are there.
    """
    step = int(step_min * 60_000_000)
    side = lambda k: ends.select(F.col("mmsi").alias(k), F.col("first_us").alias(f"{k}0"), F.col("last_us").alias(f"{k}1"), *([F.col("region")] if k == "a" else []))
    rows = shared.join(side("a"), "a").join(side("b"), "b").withColumns({"t0": F.greatest("a0", "b0"), "t1": F.least("a1", "b1")}).where(F.col("t1") - F.col("t0") >= minutes * 60e6)
    first, last = F.greatest(F.col("bin") * BIN_US, F.col("t0")), F.least((F.col("bin") + 1) * BIN_US - 1, F.col("t1"))
    spot = lambda us: (us - F.col("t0")) / step
    rows = rows.where(first <= last).select("a", "b", "bin", "region", "t0", F.ceil(spot(first)).alias("k0"), F.floor(spot(last)).alias("k1")).where("k0 <= k1")
    for k in "ba":
        own = legs.select(F.col("mmsi").alias(k), "bin", *[F.col(c).alias(f"{k}_{c}") for c in ("us", "lat", "lon", "v", "prev_us", "prev_lat", "prev_lon", "prev_v")])
        rows = rows.join(own, [k, "bin"]).withColumns({"k0": F.greatest("k0", F.floor(spot(F.col(f"{k}_prev_us"))) + 1), "k1": F.least("k1", F.floor(spot(F.col(f"{k}_us"))))}).where("k0 <= k1")
    rows = rows.withColumn("k", F.explode(F.sequence("k0", "k1"))).withColumn("t", F.col("t0") + F.col("k") * step)
    at = {k: {c: _at(c, F.col("t"), f"{k}_") for c in ("lat", "lon", "v")} for k in "ab"}
    away = haversine_km(at["a"]["lat"], at["a"]["lon"], at["b"]["lat"], at["b"]["lon"])
    met = rows.where((at["a"]["v"] <= speed_kn) & (at["b"]["v"] <= speed_kn)).select("a", "b", "bin", "k", F.col("t").alias("us"), at["a"]["lat"].alias("lat"), at["a"]["lon"].alias("lon"), away.alias("km"), "region")
    return met.where(F.col("km") <= range_km)


def _places(boxes: DataFrame, pad: float) -> DataFrame:
    """(mmsi, bin, grid, cy, cx, big) of boxes widened by pad: small ones in fine cells (grid 0); where there are big ones, these and what may meet them in cells of CELL degrees (grid 1)."""
    keep = lambda rows, grid: rows.select("mmsi", "bin", F.lit(grid).alias("grid"), "cy", "cx", "big").distinct()
    fine = keep(_touched(boxes.where("NOT big"), pad, FINE), 0)
    if not boxes.where("big").limit(1).count():
        return fine
    coarse = keep(_touched(boxes, pad, CELL), 1)
    beside = keep(_touched(boxes.where("big"), 1.0, CELL), 1).select("bin", "cy", "cx").distinct()
    return fine.unionByName(coarse.join(beside, ["bin", "cy", "cx"], "left_semi").select(*fine.columns))


def _side_by_side(spots: DataFrame, wide: DataFrame) -> DataFrame:
    """(a, b, bin), a before b, a of spots and b of wide: who shares a cell in which half hour."""
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("grid", "bin", "cy", "cx")]
    return spots.alias("l").join(wide.alias("r"), same[0] & same[1] & same[2] & same[3] & (F.col("l.mmsi") < F.col("r.mmsi")) & ((F.col("l.grid") == 0) | F.col("l.big") | F.col("r.big"))).select(F.col("l.mmsi").alias("a"), F.col("r.mmsi").alias("b"), F.col("l.bin").alias("bin")).distinct()


def _open(pairs: DataFrame, busy: DataFrame) -> DataFrame:
    """pairs without those of two busy vessels."""
    for k in "ab":
        pairs = pairs.join(busy.select(F.col("mmsi").alias(k), F.lit(True).alias(f"{k}_busy")), k, "left")
    return pairs.where("a_busy IS NULL OR b_busy IS NULL").drop("a_busy", "b_busy")


def _runs(moments: DataFrame) -> DataFrame:
    """A pair's runs of near moments within each half hour, summed up where its moments are."""
    turned = F.when(F.col("lon") < 0, F.col("lon") + 360).otherwise(F.col("lon"))
    run = F.col("k") - F.row_number().over(W.partitionBy("a", "b", "bin").orderBy("k"))
    return moments.withColumn("run", run).groupBy("a", "b", "bin", "run").agg(
        F.count("*").alias("n"), F.min("k").alias("k"), F.min("us").alias("since"), F.max("us").alias("until"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"), F.sum(turned).alias("turned"),
        F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("km").alias("km"), F.first("region").alias("region"),
    )


def _longest(parts: DataFrame, minutes: float, step_min: float) -> DataFrame:
    """A pair's longest run of near moments, the first of equal ones, if it lasts long enough and not in a port; parts are the runs of its half hours."""
    before = W.partitionBy("a", "b").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    island = F.col("k") - F.coalesce(F.sum("n").over(before), F.lit(0))
    lon = F.when(F.max("east") - F.min("west") > 180, F.sum("turned")).otherwise(F.sum("lon")) / F.sum("n")
    runs = parts.withColumn("island", island).groupBy("a", "b", "island").agg(F.sum("n").alias("n"), F.min("since").alias("ts_start_us"), F.max("until").alias("ts_end_us"), (F.sum("lat") / F.sum("n")).alias("lat"), lon.alias("lon"), F.min("km").alias("km"), F.first("region").alias("region"))
    best = runs.groupBy("a", "b").agg(F.max_by(F.struct("n", "ts_start_us", "ts_end_us", "lat", "lon", "km", "region"), F.struct(F.col("n"), -F.col("ts_start_us"))).alias("r")).select("a", "b", "r.*")
    best = best.withColumns({"minutes": (F.col("n") - 1) * F.lit(float(step_min)), "lon": to_180(F.col("lon"))}).where((F.col("minutes") >= minutes) & ~zones.in_kind(F.col("lat"), F.col("lon"), "port"))
    return best.select("a", "b", "ts_start_us", "ts_end_us", "lat", "lon", "minutes", "km", "region")


def _busy(found: DataFrame, partners: int) -> DataFrame:
    return partner_degree(found).where(F.col("degree") > partners).select("mmsi")


def _enough_meetings(positions: DataFrame, range_km: float, speed_kn: float, minutes: float, partners: int, step_min: float, transit_kn: float = 3.0, focus: DataFrame | None = None) -> DataFrame:
    """The meetings of all pairs but some of two vessels that each have more than partners others among the rest, so that the
    vessels with more than partners, and all meetings of the others, follow from it.

    In a crowd nearly every vessel has too many partners, and a few of its neighbours show it: vessels that mostly lie in
    the same cell are judged in that order first, three ahead and then nine more. Then those that share
    a cell and half hour are, if one of both isn't busy yet. A pair whose longest run isn't in a port was near outside of
    one, so the first one's places within ports need no look, and of each other pair only the half hours in which the first
    one may lie outside are looked at before the whole of it is. With focus, pairs of these vessels and what they need.

    Moments of one half hour need no other: many legs are looked at in slices of the half hours, of which only runs remain.
    """
    spark = positions.sparkSession
    ends = written(under_way(positions, transit_kn))
    legs = slow_legs(positions, speed_kn).join(ends.select("mmsi"), "mmsi", "left_semi")
    pad = _pad(range_km)
    around, cells, _, _ = _extent(pad, FINE)
    boxes = written(_boxes(legs).withColumn("big", around | (cells > FINE_CELLS)).drop("id", "slow_from", "slow_to"))
    n = slices(boxes.count(), SLICE_LEGS)
    wide = written(_places(boxes, pad))
    size = F.when(F.col("grid") == 0, FINE).otherwise(CELL)
    west = F.col("cx") * size
    whole = zones.holds_box(F.col("min_lat"), F.col("max_lat"), to_180(F.col("min_lon")), to_180(F.col("max_lon")), "port")
    in_port = zones.holds_box(F.col("cy") * size, (F.col("cy") + 1) * size, to_180(west), to_180(west) + size, "port")
    spots = _places(boxes.where(~whole), 1e-7).where(~in_port)
    if focus is not None:  # who may meet them, and who may meet those
        own = focus.select("mmsi").distinct()
        for _ in range(2):
            asked = wide.join(own, "mmsi", "left_semi").select("grid", "bin", "cy", "cx").distinct()
            own = written(wide.join(asked, ["grid", "bin", "cy", "cx"], "left_semi").select("mmsi").distinct())
        wide, spots = wide.join(own, "mmsi", "left_semi"), spots.join(own, "mmsi", "left_semi")
    spots = written(spots)
    bins = written(boxes.groupBy("mmsi", "bin").agg(F.min("min_lat").alias("s"), F.max("max_lat").alias("n")))

    def judged(pairs: DataFrame) -> DataFrame:
        def runs(part: Callable[[DataFrame], DataFrame]) -> DataFrame:
            side = lambda k: part(bins).select(F.col("mmsi").alias(k), "bin", F.col("s").alias(f"{k}s"), F.col("n").alias(f"{k}n"))
            near = pairs.join(side("a"), "a").join(side("b"), ["b", "bin"]).where((F.col("as") - 2 * pad <= F.col("bn")) & (F.col("bs") - 2 * pad <= F.col("an")))
            return _runs(moments_of(near.select("a", "b", "bin"), part(boxes), ends, range_km, speed_kn, minutes, step_min))

        def longest() -> DataFrame:
            parts = sliced(n, F.col("bin"), runs)
            return sliced(n, F.xxhash64("a", "b"), lambda part: _longest(part(parts), minutes, step_min))

        return settled(spark, longest)

    def outside(shared: DataFrame) -> DataFrame:
        shared = written(shared)

        def met(part: Callable[[DataFrame], DataFrame]) -> DataFrame:
            moments = moments_of(part(shared), part(boxes), ends, range_km, speed_kn, minutes, step_min)
            return moments.where(~zones.holds_box(F.col("lat"), F.col("lat"), F.col("lon"), F.col("lon"), "port")).select("a", "b").distinct()

        return sliced(n, F.col("bin"), met).distinct()

    homes = spots.where("grid = 0").groupBy("mmsi", "cy", "cx").agg(F.count("*").alias("n"), F.min("bin").alias("since")).groupBy("mmsi").agg(F.max_by(F.struct("cy", "cx", "since"), F.struct("n", "cy", "cx")).alias("h"))
    queue = W.partitionBy("h.cy", "h.cx").orderBy("h.since", "mmsi")
    ahead = F.array(*[F.lead("mmsi", j).over(queue) for j in range(1, AHEAD[-1] + 1)])
    crowd = written(homes.select("mmsi", ahead.alias("ahead"), F.count("*").over(W.partitionBy("h.cy", "h.cx")).alias("n")).where(F.col("n") > AHEAD[0] * 2))
    found, done, first = [], [], 1
    if crowd.limit(1).count():
        for last in AHEAD:
            pairs = crowd.select("mmsi", F.explode(F.slice("ahead", first, last - first + 1)).alias("other")).where("other IS NOT NULL").select(F.least("mmsi", "other").alias("a"), F.greatest("mmsi", "other").alias("b"))
            pairs = written(_open(pairs, busy) if found else pairs)
            found, done, first = [*found, judged(pairs)], [*done, pairs], last + 1
            busy = written(_busy(reduce(DataFrame.unionByName, found), partners))
        left = lambda rows: rows.join(busy, "mmsi", "left_anti")
        shared = _open(_side_by_side(left(spots), wide).union(_side_by_side(spots, left(wide))).distinct(), busy).join(reduce(DataFrame.union, done), ["a", "b"], "left_anti").select("a", "b", "bin")
    else:
        shared = _side_by_side(spots, wide)
    return reduce(DataFrame.unionByName, [*found, judged(written(outside(shared)))])


def meetings(positions: DataFrame | None, range_km: float = 0.5, speed_kn: float = 1.0, minutes: float = 30, partners: int = 2, step_min: float = 5, focus: DataFrame | None = None, moments: DataFrame | None = None) -> DataFrame:
    """(a, b, ts_start_us, ts_end_us, lat, lon, minutes, km, region): a pair's longest run of near moments, the first of equal ones,
    if it lasts long enough and not in a port, for vessels with few partners; moments may be given instead of positions.
    With focus (mmsi), those of these vessels."""
    found = _enough_meetings(positions, range_km, speed_kn, minutes, partners, step_min, focus=focus) if moments is None else written(_longest(_runs(moments), minutes, step_min))
    busy = written(_busy(found, partners))
    found = found.join(busy.withColumnRenamed("mmsi", "a"), "a", "left_anti").join(busy.withColumnRenamed("mmsi", "b"), "b", "left_anti")
    if focus is not None:
        own = focus.select("mmsi").distinct().withColumn("own", F.lit(True))
        found = found.join(own.select(F.col("mmsi").alias("a"), F.col("own").alias("a_own")), "a", "left").join(own.select(F.col("mmsi").alias("b"), F.col("own").alias("b_own")), "b", "left").where("a_own OR b_own").drop("a_own", "b_own")
    return found


def partner_degree(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("mmsi")).groupBy("mmsi").agg(F.count("*").alias("degree"))


def rendezvous(positions: DataFrame | None, focus: DataFrame | None = None, moments: DataFrame | None = None) -> DataFrame:
    """Incidents of meetings, one for each side. With focus (mmsi), those of these vessels; their partners' degrees stay exact."""
    found = meetings(positions, focus=focus, moments=moments).withColumn("side", F.explode(F.array(F.struct(F.col("a").alias("mmsi"), F.col("b").alias("other")), F.struct(F.col("b").alias("mmsi"), F.col("a").alias("other")))))
    if focus is not None:
        own = focus.select("mmsi").distinct()
        found = found.join(own.withColumnRenamed("mmsi", "a"), "a", "left_semi").unionByName(found.join(own.withColumnRenamed("mmsi", "b"), "b", "left_semi")).distinct()
    rows = found.select(F.col("side.mmsi").alias("mmsi"), F.col("side.other").alias("other"), "ts_start_us", "ts_end_us", "lat", "lon", F.round("minutes", 1).alias("minutes"), F.round("km", 3).alias("km"), "region", F.lit(None).cast("double").alias("knots"), (F.lit(0.55) + 0.35 * clip1(F.col("minutes") / 90)).alias("score"), F.lit(0.6).alias("confidence"))
    held = {"duration_minutes": F.col("minutes"), "min_range_km": F.col("km"), "counterpart": F.col("other"), "caveat": F.lit("pilots, tugs and bunkering look the same")}
    return incidents(rows, "rendezvous", F.lit("ship-to-ship transfer"), F.array(F.lit("sts-transfer"), F.lit("rendezvous")), F.col("other"), held)


def all_incidents(positions: DataFrame, outages: DataFrame | None = None) -> DataFrame:
    """Every detector's findings; of one id the first stays, in the order gap, rendezvous, loiter, spoof.

    Each detector's are written before the next one begins, so that what they shuffle and their tables don't add up on disk.
    """
    makes = (lambda: gaps(positions, outages), lambda: rendezvous(positions), lambda: loiters(positions), lambda: spoofs(positions))
    parts = [settled(positions.sparkSession, make) for make in makes]
    every = parts[0].withColumn("ord", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        every = every.unionByName(part.withColumn("ord", F.lit(k)))
    one = every.groupBy("incident_id").agg(F.min_by(F.struct(*COLUMNS[1:]), F.struct("ord", "ts_end_us", "lat", "lon")).alias("i"))
    return one.select("incident_id", "i.*")
