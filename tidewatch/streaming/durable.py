"""Durable micro-batches: each phase of a batch is committed once, whatever is killed and replayed.

A batch goes through four phases: reports, vessels and the set of vessels to process again; then
tracks, incidents and scores of these vessels. Every phase stages its tables and commits
them together with its name and the batch's number; a phase whose commit exists is passed over.
The set of vessels is stored with the reports, since a replayed batch finds its reports in
the store and could no longer tell what was new; the last phase takes its vessels out again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import detect, incremental, upkeep
from tidewatch.sources.shared import written
from tidewatch.sources.store import Key, Spec, Store

Staged = dict[str, dict[Key, str | None]]
Phase = Callable[[Store, DataFrame], Staged]


def opened(spark: SparkSession, path: str, positions: DataFrame, tracks: DataFrame, incidents: DataFrame, vessels: DataFrame, **sizes: int) -> Store:
    """A store of the engine's tables; the frames give the columns, their rows aren't read."""
    dirty = spark.createDataFrame([], "mmsi string").schema
    return Store(spark, path, {
        "positions": Spec(positions.schema, ("mmsi", "us"), time="us"), "vessels": Spec(vessels.schema, ("mmsi",)), "tracks": Spec(tracks.schema, ("track_id",), time="start_us"),
        "incidents": Spec(incidents.schema, ("incident_id",), time="ts_start_us"), "dirty": Spec(dirty, ("mmsi",)),
    }, **sizes)


def _dirty(store: Store) -> DataFrame:
    return store.read("dirty").select("mmsi")


def _of_dirty(store: Store, name: str, dirty: DataFrame) -> DataFrame:
    """The table's parts that hold dirty vessels."""
    parts = sorted({p for _, p in store.keys("dirty", dirty)})
    return store.read(name, parts=parts).drop("day", "part")


def flush(identities: Callable[[DataFrame], DataFrame]) -> Phase:
    """Stores new reports, widens and fills the vessels, and marks who is to be processed again."""

    def phase(store: Store, batch: DataFrame) -> Staged:
        stored = store.read("positions", store.keys("positions", batch))
        new = written(upkeep.new_positions(batch, stored))  # what is staged is read several times
        known = identities(batch)
        vessels = written(upkeep.upserted(store.read("vessels", store.keys("vessels", known)).drop("day", "part"), known))
        return {"positions": store.replace("positions", new), "vessels": store.replace("vessels", vessels), "dirty": store.replace("dirty", new.select("mmsi").distinct())}

    return phase


def retrack(store: Store, _: DataFrame) -> Staged:
    """Segments the tails of dirty vessels again."""
    dirty = _dirty(store)
    stored = _of_dirty(store, "tracks", dirty)
    tails = incremental.refreshed_tracks(_of_dirty(store, "positions", dirty), stored, dirty)
    fresh = written(tails.join(dirty, "mmsi", "left_semi").join(stored.select("track_id", "end_us", "point_count"), ["track_id", "end_us", "point_count"], "left_anti"))
    return {"tracks": store.replace("tracks", fresh)}


def rejudge(outages: DataFrame | None = None, judge: Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame] = incremental.judged_again) -> Phase:
    """Judges dirty vessels again, by all detectors unless told otherwise, and replaces the incidents that they have a part in."""

    def phase(store: Store, _: DataFrame) -> Staged:
        dirty, stored = _dirty(store), store.read("incidents").drop("day", "part")
        fresh = written(judge(store.read("positions").drop("day", "part"), dirty, outages))
        d = dirty.select(F.col("mmsi").alias("d"))
        gone = stored.join(d, F.col("mmsi") == F.col("d"), "left_semi").unionByName(stored.join(d, F.col("counterpart_mmsi") == F.col("d"), "left_semi")).distinct()
        return {"incidents": store.replace("incidents", fresh.select(*detect.COLUMNS), gone)}

    return phase


def settle(score: Callable[[Store, DataFrame], Staged] | None = None) -> Phase:
    """Scores what dirty vessels did, if a scoring is given, and takes them off the list."""

    def phase(store: Store, _: DataFrame) -> Staged:
        dirty = _dirty(store)
        return (score(store, dirty) if score else {}) | {"dirty": store.replace("dirty", dirty.limit(0), dirty)}

    return phase


def processed(store: Store, batch: DataFrame, number: int, phases: list[tuple[str, Phase]]) -> int:
    """Runs the phases that this batch hasn't been committed for, in order; the number of phases run now."""
    ran = 0
    for name, phase in phases:
        if store.state().done.get(name, -1) >= number:
            continue
        store.commit(phase(store, batch), name, number)
        ran += 1
    return ran


def lane(store: Store, phases: list[tuple[str, Phase]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a micro-batch goes through its phases; a failure leaves the committed ones, the replay does the rest."""
    return lambda batch, number: processed(store, batch, number, phases) and None
