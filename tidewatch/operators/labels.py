"""External labels and reviews: import, decisions, queues, agreement, where false alarms gather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.functions import zones
from tidewatch.operators.overlap import overlapping

QUEUE = "queue-v1"
NEGATIVE = ("normal", "ais_data_artifact")
DETECTABLE = ("gap", "rendezvous", "loiter")


def raw_imo(raw: Column) -> Column:
    """The IMO number in a raw JSON report, under any of the names that sources use."""
    # Names of fields in the sources' messages.
    paths = ("$.imo", "$.IMO", "$.imoNumber", "$.ImoNumber", "$.MetaData.IMO", "$.MetaData.imo")
    return F.coalesce(*[F.nullif(F.get_json_object(raw, p), F.lit("")) for p in paths])


def imported(stored: DataFrame, fresh: DataFrame, source: str, start_us: int, end_us: int, box: tuple[float, float, float, float], now_us: int) -> DataFrame:
    """The label table after an import: events with id and time inside window and box (south, west, north, east) replace those of the same id."""
    south, west, north, east = box
    inside = F.col("event_id").isNotNull() & F.col("ts_us").between(start_us, end_us) & F.col("lat").between(south, north) & F.col("lon").between(west, east)
    rows = fresh.where(inside).withColumns({"source_ref": F.col("event_id"), "event_id": F.concat(F.lit(f"{source}:"), F.col("event_id")), "source": F.lit(source), "source_confidence": F.lit("silver"), "retrieved_us": F.lit(now_us)})
    one = rows.groupBy("event_id").agg(F.max_by(F.struct(*[c for c in stored.columns if c != "event_id"]), F.struct("ts_us", "lat", "lon")).alias("e")).select("event_id", "e.*").select(*stored.columns)
    return stored.join(one.select("event_id"), "event_id", "left_anti").select(*stored.columns).unionByName(one)


def in_dates(events: DataFrame, first: str, until: str) -> DataFrame:
    """Events that start on a UTC date from first on, before until."""
    day = F.to_date(F.timestamp_micros("ts_us"))
    return events.where((day >= F.lit(first).cast("date")) & (day < F.lit(until).cast("date")))


def named_vessels(events: DataFrame) -> DataFrame:
    """mmsi of every vessel that an event names, as itself or as the counterpart."""
    return events.select(F.explode(F.array("mmsi", "counterpart_mmsi")).alias("mmsi")).where("mmsi IS NOT NULL AND mmsi <> ''").distinct()


def request_window(positions: DataFrame, pad: float = 0.05) -> DataFrame:
    """One row: the dates (the last one exclusive) and the padded box in which to ask for events on these reports."""
    day = lambda c: F.to_date(F.timestamp_micros(c))
    rows = positions.agg(F.min("us").alias("a"), F.max("us").alias("b"), *[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))]).where("a IS NOT NULL")
    return rows.select(day("a").cast("string").alias("first_date"), F.date_add(day("b"), 1).cast("string").alias("until_date"), *[(F.col(f"min_{c}") - pad).alias(f"min_{c}") for c in ("lat", "lon")], *[(F.col(f"max_{c}") + pad).alias(f"max_{c}") for c in ("lat", "lon")])


def covered_events(events: DataFrame, spans: DataFrame, hours: int = 0) -> DataFrame:
    """The events whose time, lasting some hours, shares an instant with an observed span."""
    ledger = spans.select((F.col("start_us") - 1).alias("from_us"), (F.col("end_us") + 1).alias("to_us"))
    met = overlapping(events.select("event_id", "ts_us", (F.col("ts_us") + hours * 3_600_000_000).alias("end")), ledger, "ts_us", "end", "event_id")
    return events.join(met.select("event_id").distinct(), "event_id", "left_semi")


def undecided(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """event_id of the events that lack any decision; decided ones have a row inside or outside coverage."""
    return events.select("event_id").distinct().join(decisions.select("event_id").distinct(), "event_id", "left_anti")


def trap_breaches(incidents: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: gap incidents on vessels whose silence the truth knows to be harmless."""
    traps = truth.where(F.col("kind") == "trap").select("mmsi")
    return incidents.where(F.col("detector") == "gap").join(traps, "mmsi", "left_semi").agg(F.count("*").alias("breaches"))


def detectors_by_track(incidents: DataFrame, incident_tracks: DataFrame) -> DataFrame:
    rows = incident_tracks.select("incident_id", "track_id").join(incidents.select("incident_id", "detector"), "incident_id")
    return rows.groupBy("track_id").agg(F.sort_array(F.collect_set("detector")).alias("detectors"))


def agreement_by_source(events: DataFrame, matches: DataFrame, by_track: DataFrame) -> DataFrame:
    """Per confidence and source: matched events in coverage, and how many of them an alert on a matched track finds.

    An official event counts any detector; a silver one only the detector of its own type,
    and only types that a detector exists for.
    """
    official = F.col("source_confidence") == "official"
    wanted = events.where(official | ((F.col("source_confidence") == "silver") & F.col("event_type").isin(*DETECTABLE)))
    met = matches.where(F.col("in_observed_coverage") & F.col("status").isin("matched", "ambiguous")).select("event_id", "track_id").join(wanted, "event_id").join(by_track, "track_id", "left")
    hit = F.when(official, F.col("detectors").isNotNull()).otherwise(F.coalesce(F.array_contains("detectors", F.col("event_type")), F.lit(False)))
    each = met.groupBy("event_id", "source_confidence", "source").agg(F.max(hit.cast("int")).alias("hit"))
    return each.groupBy("source_confidence", "source").agg(F.count("*").alias("eligible"), F.sum("hit").alias("detected"))


def progress(reviews: DataFrame) -> DataFrame:
    """Per reviewer: how many items are queued and how many done."""
    return reviews.groupBy("reviewer_id").agg(F.count("*").alias("queued"), F.count("reviewed_us").alias("done"))


def next_items(reviews: DataFrame) -> DataFrame:
    """Per reviewer the first item of the queue that isn't reviewed yet."""
    return reviews.where("reviewed_us IS NULL").groupBy("reviewer_id").agg(F.min_by(F.struct("review_id", "track_id", "queue_order"), F.struct("queue_order", "review_id")).alias("r")).select("reviewer_id", "r.*")


def queued(reviews: DataFrame, version: str = QUEUE) -> DataFrame:
    """The items of one version of the queue."""
    return reviews.where(F.col("review_id").startswith(f"{version}:"))


def latest_reviews(reviews: DataFrame, reviewer: str = "primary") -> DataFrame:
    """Each track's last finished review by one reviewer."""
    done = reviews.where((F.col("reviewer_id") == reviewer) & F.col("reviewed_us").isNotNull())
    return done.groupBy("track_id").agg(F.max_by(F.struct("review_id", "label", "stratum", "reviewed_us"), F.struct("reviewed_us", "review_id")).alias("r")).select("track_id", "r.*")


def review_again(reviews: DataFrame, now_us: int, share: float = 0.15, days: int = 3, seed: str = "queue-v1-again") -> DataFrame:
    """A seeded share, one at least, of the primary reviews that are some days old and not yet queued again."""
    old = latest_reviews(reviews).where(F.col("reviewed_us") <= now_us - days * 86_400_000_000)
    again = reviews.where(F.col("reviewer_id") == "primary-rereview").select("track_id").distinct()
    open_ = old.join(again, "track_id", "left_anti")
    n, before = open_.count(), again.count()
    most = max(1, round(n * share)) if n else 0
    rows = open_.withColumn("digest", F.sha2(F.concat(F.lit(seed), "track_id"), 256)).orderBy("digest", "track_id").limit(most)  # a bounded sample
    order = F.row_number().over(W.orderBy("digest", "track_id")).cast("long") + before
    return rows.withColumn("queue_order", order).select(F.concat(F.lit(f"{QUEUE}-rereview:"), F.lpad(F.col("queue_order").cast("string"), 4, "0")).alias("review_id"), "track_id", "queue_order", "stratum", F.lit("primary-rereview").alias("reviewer_id"))


def adjudicated(reviews: DataFrame, resolutions: DataFrame) -> DataFrame:
    """track_id, adjudication of tracks reviewed twice: agree, resolved by a third look (track_id, label), or open."""
    both = latest_reviews(reviews).select("track_id", "label").join(latest_reviews(reviews, "primary-rereview").select("track_id", F.col("label").alias("again")), "track_id").join(resolutions.select("track_id", F.col("label").alias("third")), "track_id", "left")
    verdict = F.when(F.col("label") == F.col("again"), "agree").when(F.col("third").isNotNull(), F.concat(F.lit("resolved-"), F.col("third"))).otherwise("open")
    return both.select("track_id", verdict.alias("adjudication"))


def false_alarms(incidents: DataFrame, incident_tracks: DataFrame, reviews: DataFrame, vessels: DataFrame, spans: DataFrame) -> DataFrame:
    """grouping, value, n: where incidents on tracks reviewed as harmless gather, by grade, kind of zone, vessel type and coverage."""
    calm = latest_reviews(reviews).where(F.col("label").isin(*NEGATIVE)).select("track_id")
    rows = incident_tracks.select("incident_id", "track_id").join(calm, "track_id", "left_semi").join(incidents, "incident_id")
    kinds = F.create_map(*[F.lit(x) for z in zones.ZONES for x in (z[0], z[1])])
    ledger = spans.select((F.col("start_us") - 1).alias("from_us"), (F.col("end_us") + 1).alias("to_us"))
    seen = overlapping(rows.select("incident_id", "ts_start_us", "ts_end_us"), ledger, "ts_start_us", "ts_end_us", "incident_id").select("incident_id").distinct().withColumn("seen", F.lit(1))
    rows = rows.join(vessels.select("mmsi", "ship_type"), "mmsi", "left").join(seen, "incident_id", "left")
    facts = {"reliability_grade": F.col("reliability"), "zone_kind": F.coalesce(F.try_element_at(kinds, F.col("zone_id")), F.lit("open-strait")), "vessel_type": F.coalesce("ship_type", F.lit("unknown")), "coverage_state": F.when(F.col("seen") == 1, "observed").otherwise("outage-or-unobserved")}
    pairs = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("grouping"), c.alias("value")) for n, c in facts.items()])).alias("x")).select("x.*")
    return pairs.groupBy("grouping", "value").agg(F.count("*").alias("n"))


def blinded(tracks: DataFrame, shapes: DataFrame) -> DataFrame:
    """mmsi, voyage, step, x_km, y_km, speed_kn, turn_degrees: a track's route and pace without place, identity or score.

    Steps are summed up to points relative to the start; speeds come from the even time between them.
    """
    rows = shapes.select("mmsi", "voyage", F.posexplode("sequence").alias("at", "s"), F.size("sequence").alias("n")).join(tracks.select("mmsi", "voyage", "start_us", "end_us"), ["mmsi", "voyage"])
    upto = W.partitionBy("mmsi", "voyage").orderBy("at")
    hours = (F.col("end_us") - F.col("start_us")) / F.lit(3.6e9) / F.col("n")
    speed = F.when(hours > 0, F.col("s")[2] / 1.852 / hours).otherwise(0.0)
    return rows.select("mmsi", "voyage", (F.col("at") + 1).alias("step"), F.round(F.sum(F.col("s")[0]).over(upto), 5).alias("x_km"), F.round(F.sum(F.col("s")[1]).over(upto), 5).alias("y_km"), F.round(speed, 2).alias("speed_kn"), F.round(F.col("s")[3], 2).alias("turn_degrees"))
