"""The live lane: outages by timers, durable micro-batches."""

import time

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import detect, tracks
from tidewatch.sources.store import Spec, Store
from tidewatch.streaming import durable, outages

S = 1_000_000


def _until(test, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if (found := test()) is not None:
            return found
        time.sleep(0.3)
    raise AssertionError("nothing came in time")


class _Feed:
    """A folder of reports, and the ledger rows that a watching query has written."""

    def __init__(self, spark, folder, silence_s):
        self.spark, self.folder, self.silence_s, self.n, self.said = spark, folder, silence_s, 0, []
        (folder / "in").mkdir()

    def say(self, *rows):
        self.n += 1
        self.spark.createDataFrame(rows, "key string, us long").coalesce(1).write.json(f"{self.folder}/tmp{self.n}")
        (part,) = (self.folder / f"tmp{self.n}").glob("part-*.json")
        part.rename(self.folder / "in" / f"{self.n}.json")

    def start(self):
        stream = self.spark.readStream.schema("key string, us long").json(str(self.folder / "in"))
        keep = lambda rows, _: self.said.extend((r["key"], r["opened_us"], r["closed_us"]) for r in rows.collect())
        return outages.watch(stream, self.silence_s).writeStream.foreachBatch(keep).option("checkpointLocation", str(self.folder / "check")).trigger(processingTime="300 milliseconds").start()

    def rows(self):
        return sorted(self.said, key=str)


def test_a_silent_feed_opens_one_outage_and_a_report_closes_it(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    outages.with_timers(spark)
    try:
        feed = _Feed(spark, tmp_path, 3)
        feed.say(("a", 100 * S), ("a", 101 * S), ("b", 100 * S), ("b", 100 * S))
        query = feed.start()
        opened = [("a", 104 * S, None), ("b", 103 * S, None)]
        assert _until(lambda: (r := feed.rows()) and len(r) >= 2 and r or None) == opened
        time.sleep(5)
        assert feed.rows() == opened  # one each, however long it lasts
        query.stop()
        query = feed.start()  # from the checkpoint: nothing is said twice
        time.sleep(5)
        assert feed.rows() == opened
        feed.say(("a", 99 * S))  # late: closes nothing
        feed.say(("a", 150 * S))
        assert _until(lambda: (r := feed.rows()) and len(r) >= 3 and r or None)[:3] == sorted([*opened, ("a", 104 * S, 150 * S)], key=str)
        query.stop()
        time.sleep(1)
        feed.say(("a", 200 * S), ("a", 201 * S))  # silent while nothing ran: found by the reports' times
        query = feed.start()
        got = _until(lambda: (r := feed.rows()) and ("a", 153 * S, 200 * S) in r and r or None)
        query.stop()
        said = [r for r in got if r[0] == "b" or r[1] < 204 * S]
        # The outage of 153 may have been opened by its timer before it was closed by the report.
        assert sorted({(k, o) for k, o, _ in said}) == [("a", 104 * S), ("a", 153 * S), ("b", 103 * S)]
        ledger = {(r["key"], r["opened_us"]): r["closed_us"] for r in outages.ledger(spark.createDataFrame([(*r, "x") for r in said], outages.LEDGER)).collect()}
        assert ledger == {("a", 104 * S): 150 * S, ("a", 153 * S): 200 * S, ("b", 103 * S): None}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


# durable batches ------------------------------------------------------------------------

T0, MIN = 1_704_067_200_000_000, 60_000_000
POSITIONS = "id long, mmsi string, us long, lat double, lon double, sog double, heading double, nav_status string, source string, region string"


def _reports(spark, n, first=0):
    """Some vessels on their ways, with silences, jumps, dwelling and a meeting."""
    rows = []
    for k in range(first, first + n):
        for v in range(8):
            if v == 3 and k % 24 > 7:
                continue
            far = 0.3 if v == 2 and k % 9 == 8 else 0.01 * k if v == 3 else 0.0
            moved = 0.0 if v in (4, 5) and k % 20 > 3 else 0.004 * (k % 20)
            rows.append((k * 8 + v, f"v{v}", T0 + k * 10 * MIN, 5.0 + (0 if v in (4, 5) else v) + moved + far, 80.0 + (0.001 if v == 5 else 0.0), 1.0 if v == 6 else 0.5 if v in (4, 5) and k % 20 > 3 else 8.0, 0.0, "0", "aisstream", "sg"))
    return spark.createDataFrame(rows, POSITIONS)


def _identities(batch):
    return batch.groupBy("mmsi").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max(F.concat(F.lit("ship "), "mmsi")).alias("name"))


def _store(spark, path):
    p = _reports(spark, 1)
    return durable.opened(spark, str(path), p, tracks.summaries(p), detect.all_incidents(p), _identities(p))


def _spoofs(positions, dirty, _):
    return detect.spoofs(positions.join(dirty, "mmsi", "left_semi"))


FULL = [("flush", durable.flush(_identities)), ("tracks", durable.retrack), ("incidents", durable.rejudge()), ("scores", durable.settle())]
PHASES = [("flush", durable.flush(_identities)), ("tracks", durable.retrack), ("incidents", durable.rejudge(judge=_spoofs)), ("scores", durable.settle())]


def _tables(store):
    cut = lambda v: round(v, 9) if isinstance(v, float) else v
    return {name: sorted(str([cut(v) for v in r]) for r in store.read(name).collect()) for name in store.specs}


@pytest.fixture(scope="module")
def batches(spark):
    every = _reports(spark, 60)
    return [every.where("id < 240"), every.where("id >= 200")]


@pytest.fixture(scope="module")
def clean(spark, batches, tmp_path_factory):
    store = _store(spark, tmp_path_factory.mktemp("clean"))
    for number, batch in enumerate(batches):
        assert durable.processed(store, batch, number, PHASES) == 4
    return store


def test_stored_tables_equal_a_full_build(spark, batches, tmp_path):
    p, clean = _reports(spark, 60), _store(spark, tmp_path)
    for number, batch in enumerate(batches):
        assert durable.processed(clean, batch, number, FULL) == 4
    ids = lambda rows, c: sorted(r[c] for r in rows.collect())
    assert ids(clean.read("positions"), "id") == ids(p, "id") and clean.read("dirty").count() == 0
    got, want = clean.read("tracks"), tracks.summaries(p)
    assert sorted((r["track_id"], r["voyage"], r["point_count"]) for r in got.collect()) == sorted((r["track_id"], r["voyage"], r["point_count"]) for r in want.collect())
    found = detect.all_incidents(p)
    assert {r["detector"] for r in found.select("detector").distinct().collect()} >= {"gap", "spoof", "loiter"}
    assert sorted((r["incident_id"], r["score"]) for r in clean.read("incidents").collect()) == sorted((r["incident_id"], r["score"]) for r in found.collect())
    assert clean.read("vessels").where("name LIKE 'ship v%'").count() == 8


@pytest.mark.parametrize(("phase", "late"), [(0, True), (1, False), (2, True), (3, False)])
def test_a_killed_phase_is_replayed_to_the_same_tables(spark, batches, clean, tmp_path, phase, late):
    store = _store(spark, tmp_path)
    durable.processed(store, batches[0], 0, PHASES)

    def broken(at, batch):
        if late:
            PHASES[phase][1](at, batch)  # everything is staged, nothing committed
        raise OSError("killed")

    failing = [*PHASES[:phase], (PHASES[phase][0], broken), *PHASES[phase + 1 :]]
    with pytest.raises(OSError):
        durable.processed(store, batches[1], 1, failing)
    again = _store(spark, tmp_path)  # as after a restart: everything comes from the shared folder
    assert durable.processed(again, batches[1], 1, PHASES) == 4 - phase
    assert durable.processed(again, batches[1], 1, PHASES) == 0
    assert _tables(again) == _tables(clean)
    before = _tables(again)
    assert again.vacuum() > 0 and again.vacuum() == 0 and _tables(again) == before


def test_a_stream_goes_through_the_phases(spark, batches, clean, tmp_path):
    store = _store(spark, tmp_path / "store")
    for number, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(POSITIONS).parquet(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(durable.lane(store, PHASES)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert store.state().done == dict.fromkeys(("flush", "tracks", "incidents", "scores"), number)
    assert _tables(store) == _tables(clean)


def test_only_touched_parts_are_written_and_windows_need_no_exchange(spark, clean, tmp_path):
    store = Store(spark, str(tmp_path), {"positions": Spec(spark.createDataFrame([], POSITIONS).schema, ("mmsi", "us"), time="us")}, parts=3, buckets=2)
    rows = _reports(spark, 400)  # some days
    store.commit({"positions": store.replace("positions", rows)}, "flush", 0)
    first = store.state().places["positions"]
    assert len({k.split("/")[0] for k in first}) >= 3 and len(store.read("positions").inputFiles()) <= 2 * len(first)
    one = rows.where(f"mmsi = 'v1' AND us < {T0 + 60 * MIN}").withColumn("us", F.col("us") + 1)
    store.commit({"positions": store.replace("positions", one)}, "flush", 1)
    second = store.state().places["positions"]
    assert set(first) == set(second) and sum(first[k] != second[k] for k in first) == 1
    assert store.read("positions").count() == rows.count() + one.count()
    key = next(iter(store.keys("positions", one)))
    assert 0 < len(store.read("positions", [key]).inputFiles()) <= 2
    plan = tracks.steps(store.read("positions"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan
    pruned = store.read("positions").where(f"day = {key[0]}")
    assert len(pruned.inputFiles()) < len(store.read("positions").inputFiles())
    store.commit({"positions": store.replace("positions", one.limit(0), store.read("positions", [key]))}, "prune", 2)
    assert store.read("positions", [key]).count() == 0 and f"day={key[0]}/part={key[1]}" not in store.state().places["positions"]


# the stored meeting index ---------------------------------------------------------------


def test_meetings_from_the_index_equal_the_full_build(spark, tmp_path):
    from tidewatch.operators import meeting_index

    rows = []
    for k in range(120):  # pairs that lie together for a while, on several days; v9 stays away
        for v in range(10):
            still = 20 < k % 40 < 33 and v != 9
            rows.append((k * 10 + v, f"v{v}", T0 + k * 40 * MIN, 5.0 + (v // 2 if still else v) * 0.3 + (0.001 * (v % 2) if still else 0.01 * (k % 20)), 80.0, 0.3 if still else 8.0, 0.0, "0", "aisstream", "sg"))
    p = spark.createDataFrame(rows, POSITIONS)
    early = p.where(f"us < {T0 + 2400 * MIN} OR mmsi <> 'v3'")
    store = Store(spark, str(tmp_path), meeting_index.specs(spark), parts=2, buckets=2)
    store.commit(meeting_index.refreshed(store, early, early.select("mmsi").distinct()), "index", 0)
    before = store.state().places["legs"]
    dirty = spark.createDataFrame([("v3",)], "mmsi string")
    store.commit(meeting_index.refreshed(store, p.where("mmsi = 'v3'"), dirty), "index", 1)
    after = store.state().places["legs"]
    assert any(before.get(k) == v for k, v in after.items())  # parts without v3 stay as they are
    every = lambda rows: sorted(str((r["a"], r["b"], r["k"], r["us"], round(r["lat"], 9), round(r["km"], 9))) for r in rows.collect())
    want = every(detect.near_moments(p, focus=dirty))
    assert want and every(meeting_index.moments(store, dirty)) == want
    found = lambda rows: sorted((r["incident_id"], r["score"]) for r in rows.collect())
    assert found(meeting_index.rendezvous(store, dirty)) == found(detect.rendezvous(p, dirty)) != []
    cells = store.read("cells")
    asked = cells.join(dirty, "mmsi", "left_semi").where(f"day = {T0 // 86_400_000_000}")
    plan = meeting_index.met(cells, asked)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and len(cells.where(f"day = {T0 // 86_400_000_000}").inputFiles()) < len(cells.inputFiles())


def test_new_reports_are_found_once_a_batch(spark, tmp_path, monkeypatch):
    """The reports that a batch brings are staged, and mark vessels as dirty, from one computation."""
    from tidewatch.operators import upkeep

    p = spark.createDataFrame([(k, f"v{k % 2}", T0 + k * 10 * MIN, 5.0, 80.0, 8.0, 0.0, "0", "aisstream", "sg") for k in range(20)], POSITIONS)
    known = lambda batch: batch.groupBy("mmsi").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max("nav_status").alias("status"))
    store = durable.opened(spark, str(tmp_path / "store"), p, tracks.summaries(p), detect.spoofs(p), known(p))
    plain, log = upkeep.new_positions, str(tmp_path / "log")

    def noted(batches):
        with open(log, "a") as f:
            f.write("once\n")
        yield from batches

    monkeypatch.setattr(upkeep, "new_positions", lambda *given: (lambda rows: rows.coalesce(1).mapInPandas(noted, rows.schema))(plain(*given)))
    durable.processed(store, p, 0, [("flush", durable.flush(known))])
    assert store.read("positions").count() == 20 and store.read("dirty").count() == 2
    assert open(log).read().count("once") == 1
