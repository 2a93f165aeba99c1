"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Documents stand on the ring at the hash of their text, so equal texts stand together, in
the order of doc_id. Each shard owns the arcs before its virtual nodes and fills with its
own documents, clockwise, up to a capacity in bytes; what overflows continues clockwise to
the next shard with room. The walk works on the byte totals of arcs, a table whose size is
fixed by the ring; documents look their shard up by their running byte offset. Where a
shard's end falls inside a group of equal texts, the whole group goes to the first shard
clockwise that takes it with a little slack; only a group that fits nowhere is divided.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import partitions, pinned, table
from tidewatch.llm.text import mix

SHARDS = 24
VNODES = 64
SLACK = 0.001
GROUP_SLACK = 0.02
EXTRA_BYTES = 8
_OUT = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


class Ring:
    """Virtual nodes in clockwise order: arc k ends at edges[k]; the last arc wraps to the first node."""

    def __init__(self, shards: int, vnodes: int):
        place = mix(np.arange(1, shards * vnodes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        order = np.argsort(place)
        self.shards, self.edges = shards, place[order]
        self.owner = np.append(order // vnodes, order[0] // vnodes)

    def arcs(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, place, side="left")


def walk(ring: Ring, loads: np.ndarray, capacity: int) -> list[tuple[int, int, int]]:
    """(begin, end, shard) of the bytes on the ring, in ring order, none above its capacity.

    First every shard fills with the heads of its own arcs; then each arc's overflow goes
    on clockwise to the owners of the following arcs.
    """
    begin = np.concatenate([[0], np.cumsum(loads)])
    room = np.full(ring.shards, capacity, np.int64)
    pieces, rest = [], []
    for k in np.flatnonzero(loads).tolist():
        s = int(ring.owner[k])
        take = int(min(loads[k], room[s]))
        room[s] -= take
        if take:
            pieces.append((int(begin[k]), int(begin[k]) + take, s))
        if take < loads[k]:
            rest.append((k, int(begin[k]) + take, int(begin[k + 1])))
    for k, a, b in rest:
        j = k
        while a < b:
            j = (j + 1) % len(ring.owner)
            s = int(ring.owner[j])
            take = int(min(b - a, room[s]))
            if take:
                pieces.append((a, a + take, s))
                room[s] -= take
                a += take
    return sorted(pieces)


def keep_groups(pieces: list[tuple[int, int, int]], room: np.ndarray, groups: list[tuple[int, int, int]]) -> dict[int, int]:
    """The shard of each group (begin, end, place) that pieces divide and some shard has room for as a whole, the
    largest groups first; room is what each shard may still take, and is kept up to date."""
    edges, owners = np.array([p[0] for p in pieces], np.int64), np.array([p[2] for p in pieces], np.int64)
    out = {}
    for begin, end, place in sorted(groups, key=lambda g: (g[0] - g[1], g[0])):
        first, last = int(np.searchsorted(edges, begin, side="right")) - 1, int(np.searchsorted(edges, end, side="left")) - 1
        if first == last:
            continue
        held = np.zeros(len(room), np.int64)
        for a, b, s in pieces[first : last + 1]:
            held[s] += min(b, end) - max(a, begin)
        ahead = [int(owners[(first + j) % len(owners)]) for j in range(len(owners))]
        whole = next((s for s in ahead if room[s] + held[s] >= end - begin), None)
        if whole is not None:
            room += held
            room[whole] -= end - begin
            out[place] = whole
    return out


def bounded_shards(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, slack: float = SLACK, group_slack: float = GROUP_SLACK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    The law is "bytes": a row's size is its text's UTF-8 bytes (none for null) plus 8. The ring
    fills no shard above (1 + slack) times the mean; to keep equal texts together a shard
    takes up to (1 + group_slack) times the mean, and gives up no more than others so take.
    A group that no shard has room for is divided, and then a document that fits nowhere
    whole exceeds the bound alone. Slots count a shard's rows from 0 in ring order.
    Repeated rows are placed one by one; rows with a null doc_id come first among equal
    texts; grown_shard is null under this law. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + EXTRA_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("place"))
    n = partitions(docs.sparkSession)
    rows = pinned(rows.repartitionByRange(n, "place", "doc_id").sortWithinPartitions("place", "doc_id"))
    ring, context = Ring(shards, vnodes), docs.sparkSession.sparkContext

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(ring.owner), np.int64)
        for batch in batches:
            np.add.at(held, ring.arcs(batch["place"].to_numpy()), batch["size"].to_numpy())
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), TaskContext.get().partitionId())), pa.array(used), pa.array(held[used])], ["part", "arc", "bytes"])

    found = rows.mapInArrow(totals, "part long, arc long, bytes long").collect()
    loads, before = np.zeros(len(ring.owner), np.int64), np.zeros(rows.rdd.getNumPartitions() + 1, np.int64)
    for r in found:
        loads[r["arc"]] += r["bytes"]
        before[r["part"] + 1] += r["bytes"]
    before, total = np.cumsum(before), int(loads.sum())
    pieces = walk(ring, loads, max(1, ceil(total / shards * (1 + slack))))
    edges, owners = np.array([p[0] for p in pieces] or [0], np.int64), np.array([p[2] for p in pieces] or [0], np.int64)
    room = np.full(shards, max(1, ceil(total / shards * (1 + group_slack))), np.int64)
    for a, b, s in pieces:
        room[s] -= b - a
    sent = context.broadcast((before, edges, owners))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(place, begin, end) of this partition's part of the groups that a piece's end lies in, and of its first and last group."""
        before, edges, _ = sent.value
        at = start = int(before[TaskContext.get().partitionId()])
        last, out = None, []

        def done(end: int, final: bool) -> None:
            inside = np.searchsorted(edges, start, side="right") < np.searchsorted(edges, end, side="left")
            if last is not None and (inside or final or not out):
                out.append((last, start, end))

        for batch in batches:
            place, size = batch["place"].to_numpy(), batch["size"].to_numpy()
            ends = at + np.cumsum(size)
            for k in np.flatnonzero(np.append(True, place[1:] != place[:-1])).tolist():
                if place[k] != last:
                    here = int(ends[k] - size[k])
                    done(here, False)
                    last, start = int(place[k]), here
            at = int(ends[-1]) if len(ends) else at
        done(at, True)
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(3)], ["place", "begin", "end"])

    spans: dict[int, tuple[int, int]] = {}
    for r in rows.mapInArrow(runs, "place long, begin long, end long").collect():  # a few for each partition and piece
        a, b = spans.get(r["place"], (r["begin"], r["end"]))
        spans[r["place"]] = min(a, r["begin"]), max(b, r["end"])
    kept = keep_groups(pieces, room, [(a, b, place) for place, (a, b) in spans.items()])
    groups = context.broadcast((np.array(sorted(kept), np.int64), np.array([kept[p] for p in sorted(kept)], np.int64)))
    moved: dict[tuple[int, int], int] = {}

    def placed(batches: Iterator[pa.RecordBatch], moved: dict) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        (before, edges, owners), (whole, target) = sent.value, groups.value
        at = int(before[TaskContext.get().partitionId()])
        for batch in batches:
            size, place = batch["size"].to_numpy(), batch["place"].to_numpy()
            begin = at + np.concatenate([[0], np.cumsum(size)])
            k = np.searchsorted(edges, begin[:-1], side="right") - 1
            shard = owners[k].copy()
            over = np.searchsorted(edges, begin[1:], side="left") - 1 > k  # the document goes on behind its piece's end
            if len(whole):
                g = np.minimum(np.searchsorted(whole, place), len(whole) - 1)
                own = whole[g] == place
                shard[own], over = target[g[own]], over & ~own
            for i in np.flatnonzero(over):
                shard[i] = moved.get((int(begin[i]), int(size[i])), shard[i])
            yield batch, begin[:-1], shard, over
            at = int(begin[-1])

    def astride(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begin, shard, over in placed(batches, {}):
            yield pa.RecordBatch.from_arrays([pa.array(begin[over]), pa.array(batch["size"].to_numpy()[over]), pa.array(shard[over])], ["begin", "size", "shard"])

    across = sorted((r["begin"], r["size"]) for r in rows.mapInArrow(astride, "begin long, size long, shard long").collect())
    for begin, size in across:  # their bytes come off the pieces they touch
        for k in range(int(np.searchsorted(edges, begin, side="right")) - 1, int(np.searchsorted(edges, begin + size, side="left"))):
            a, b, s = pieces[k]
            room[s] += min(b, begin + size) - max(a, begin)
    for begin, size in sorted(across, key=lambda x: (-x[1], x[0])):
        first = int(np.searchsorted(edges, begin, side="right")) - 1
        ahead = [int(owners[(first + j) % len(owners)]) for j in range(len(owners))]
        s = next((s for s in ahead if room[s] >= size), int(np.argmax(room)))
        moved[begin, size] = s
        room[s] -= size

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(shards, np.int64)
        for _, _, shard, _ in placed(batches, moved):
            held += np.bincount(shard, minlength=shards)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([held.tobytes()], pa.binary())], ["part", "held"])

    held = {r["part"]: np.frombuffer(r["held"], np.int64) for r in rows.mapInArrow(counts, "part long, held binary").collect()}
    first, at = {}, np.zeros(shards, np.int64)
    for part in sorted(held):
        first[part] = at
        at = at + held[part]
    slots = context.broadcast(first)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_ = slots.value[TaskContext.get().partitionId()].copy()
        for batch, _, shard, _ in placed(batches, moved):
            slot = np.empty(len(shard), np.int64)
            for s in np.unique(shard).tolist():
                own = np.flatnonzero(shard == s)
                slot[own] = next_[s] + np.arange(len(own))
                next_[s] += len(own)
            n = len(shard)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["size"], batch["text_crc32"], pa.array(["bytes"] * n, pa.string()), pa.array(shard.astype(np.int32)), pa.array(slot), pa.nulls(n, pa.int32())], ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"])

    return rows.mapInArrow(finish, _OUT)


def op6_bounded_ring(spark, sf_dir: str) -> DataFrame:
    return bounded_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
