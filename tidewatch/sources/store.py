"""Tables of the engine in the shared folder: partitioned by day and share of the vessels, bucketed by vessel, replaced part by part.

A part is the rows of one day and one share of the vessels. New contents of a part are
written beside the old ones; one small file of a log, renamed into its place, makes all parts of a
commit valid at once and notes which phase of which batch it belongs to. Readers see
the parts of the last commit as one bucketed table of Spark, so that windows by vessel need no exchange and
filters on day and part prune the scan. One writer at a time is assumed, as with a streaming query.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.sources.shared import exists, removed

DAY_US = 86_400_000_000
PARTS, BUCKETS = 4, 4
Key = tuple[int, int]  # day and part


@dataclass(frozen=True)
class Spec:
    """A table's columns, the vessel's column, the column of its time (None: one day holds all) and what identifies a row."""

    schema: StructType
    ids: tuple[str, ...]
    vessel: str = "mmsi"
    time: str | None = None


@dataclass
class State:
    """What the last commit says: its number, where each table's parts lie, and the last batch that each phase has done."""

    number: int = -1
    places: dict[str, dict[str, str]] = field(default_factory=dict)
    done: dict[str, int] = field(default_factory=dict)


def _name(key: Key) -> str:
    return f"day={key[0]}/part={key[1]}"


def _key(name: str) -> Key:
    day, part = name.split("/")
    return int(day.removeprefix("day=")), int(part.removeprefix("part="))


class Store:
    def __init__(self, spark: SparkSession, path: str, specs: dict[str, Spec], parts: int = PARTS, buckets: int = BUCKETS):
        self.spark, self.path, self.specs, self.parts, self.buckets = spark, path.rstrip("/"), specs, parts, buckets
        self._jvm = spark.sparkContext._jvm

    # the log ---------------------------------------------------------------------------

    def _fs(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def state(self) -> State:
        at, fs = self._fs(f"{self.path}/log")
        if not fs.exists(at):
            return State()
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
        if not numbers:
            return State()
        one, fs = self._fs(f"{self.path}/log/{max(numbers):012d}.json")
        stream = fs.open(one)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return State(**json.loads(text))

    def commit(self, staged: dict[str, dict[Key, str | None]], phase: str, batch: int) -> State:
        """Makes staged parts valid, all at once; None empties a part."""
        old = self.state()
        new = State(old.number + 1, {t: dict(p) for t, p in old.places.items()}, old.done | {phase: batch})
        for name, parts in staged.items():
            held = new.places.setdefault(name, {})
            for key, place in parts.items():
                if place is None:
                    held.pop(_name(key), None)
                else:
                    held[_name(key)] = place
        draft, fs = self._fs(f"{self.path}/log/_draft-{uuid4().hex}")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(new.__dict__, sort_keys=True).encode()))
        finally:
            out.close()
        final, fs = self._fs(f"{self.path}/log/{new.number:012d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"commit {new.number} exists: another writer is at work")
        return new

    # reading ---------------------------------------------------------------------------

    def keyed(self, name: str, rows: DataFrame) -> DataFrame:
        """rows with their day and part."""
        spec = self.specs[name]
        day = F.lit(0) if spec.time is None else F.floor(F.col(spec.time) / DAY_US)
        return rows.withColumns({"day": day.cast("int"), "part": F.pmod(F.xxhash64(spec.vessel), F.lit(self.parts)).cast("int")})

    def keys(self, name: str, *rows: DataFrame) -> list[Key]:
        """The parts that rows belong to: few numbers, however many rows there are."""
        found: set[Key] = set()
        for r in rows:
            found |= {(x["day"], x["part"]) for x in self.keyed(name, r).select("day", "part").distinct().collect()}
        return sorted(found)

    def read(self, name: str, keys: Iterable[Key] | None = None, parts: Sequence[int] | None = None) -> DataFrame:
        """The table as of the last commit, with day and part; of given parts only, if asked so. It is bucketed by vessel."""
        spec, held = self.specs[name], self.state().places.get(name, {})
        wanted = None if keys is None else set(keys)
        chosen = {k: p for k, p in ((_key(n), p) for n, p in held.items()) if (wanted is None or k in wanted) and (parts is None or k[1] in parts)}
        table = f"store_{name}_{uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spec.schema.fields)
        self.spark.sql(f"CREATE TABLE {table} ({columns}, day int, part int) USING parquet PARTITIONED BY (day, part) CLUSTERED BY (`{spec.vessel}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}/none'")
        if chosen:
            added = " ".join(f"PARTITION (day={d}, part={p}) LOCATION '{self.path}/{place}'" for (d, p), place in sorted(chosen.items()))
            self.spark.sql(f"ALTER TABLE {table} ADD {added}")
        return self.spark.table(table)

    # writing ---------------------------------------------------------------------------

    def stage(self, name: str, rows: DataFrame, touched: Iterable[Key]) -> dict[Key, str | None]:
        """Writes the new contents of the touched parts beside the old ones; valid with commit()."""
        spec, place, table = self.specs[name], f"data/{name}/{uuid4().hex}", f"stage_{uuid4().hex}"
        shaped = self.keyed(name, rows.select(*[F.col(f.name).cast(f.dataType.simpleString()).alias(f.name) for f in spec.schema.fields]))
        one_file = shaped.repartition("day", "part", F.pmod(F.hash(spec.vessel), F.lit(self.buckets)))  # of a part and bucket
        one_file.write.partitionBy("day", "part").bucketBy(self.buckets, spec.vessel).sortBy(*spec.ids).option("path", f"{self.path}/{place}").format("parquet").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # external: the files stay
        return {k: (p if exists(self.spark, f"{self.path}/{p}") else None) for k in touched for p in [f"{place}/{_name(k)}"]}

    def replace(self, name: str, fresh: DataFrame, gone: DataFrame | None = None) -> dict[Key, str | None]:
        """Stages the table without the rows of gone, and with those of fresh, which replace rows of the same identity.

        Only parts that hold such rows are read and written. A row whose identity stays must stay on its day.
        """
        spec = self.specs[name]
        touched = self.keys(name, fresh, *([] if gone is None else [gone]))
        if not touched:
            return {}
        ids = list(spec.ids)
        out = fresh.select(*ids) if gone is None else fresh.select(*ids).unionByName(gone.select(*ids))
        kept = self.read(name, touched).select(*spec.schema.names).join(out.distinct(), ids, "left_anti")
        return self.stage(name, kept.select(*spec.schema.names).unionByName(fresh.select(*spec.schema.names)), touched)

    def vacuum(self) -> int:
        """Removes what no part of the last commit lies in; the number of folders removed. Readers of older commits must be done."""
        used = {p.split("/day=")[0] for parts in self.state().places.values() for p in parts.values()}
        stale = []
        for name in self.specs:
            at, fs = self._fs(f"{self.path}/data/{name}")
            if fs.exists(at):
                stale += [f"data/{name}/{s.getPath().getName()}" for s in fs.listStatus(at)]
        stale = [p for p in stale if p not in used]
        removed(self.spark, *[f"{self.path}/{p}" for p in stale])
        return len(stale)
