"""Line deduplication by probing a sharded minimal perfect hash.

The keys of long lines are counted over all documents. Keys found in enough documents
go, shard by shard, into a minimal perfect hash whose slots index compact arrays of
fingerprints, counts and last holders. Documents then probe those arrays; lines are
never joined. Where all arrays together stay under ``BROADCAST_BYTES`` they are sent to
the executors; above that, probes travel to the shard that holds their array, and the hits
meet the texts by doc_id. Of the texts only those travel that lose a line: a bit table of fixed
size tells the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewatch.llm.exact_dedup import bit_table, marked
from tidewatch.llm.tables import cut, hot, table
from tidewatch.llm.text import digest, line_keys, mix

MIN_CHARS = 40
MIN_DOCS = 5
SHARD_KEYS = 250_000
BROADCAST_BYTES = 32 << 20
ROUTE_ROWS = 1_000_000
_LEVELS = 40


def _long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


# -- minimal perfect hash ---------------------------------------------------------------


def build(keys: np.ndarray) -> dict:
    """A minimal perfect hash of distinct 64-bit keys: bit levels in which each key is alone."""
    levels, sizes, rest = [], [], keys.astype(np.uint64)
    while len(rest) and len(levels) < _LEVELS:
        size = max(64, 2 * len(rest))
        place = _place(rest, len(levels), size)
        alone = np.bincount(place, minlength=size) == 1
        levels.append(alone)
        sizes.append(size)
        rest = rest[~alone[place]]
    bits = np.concatenate(levels) if levels else np.zeros(0, bool)
    return {"bits": bits, "sizes": sizes, "rank": np.cumsum(bits, dtype=np.int64) - 1, "rest": np.sort(rest)}


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return (mix(keys + seed) % np.uint64(size)).astype(np.int64)


def slots(mph: dict, keys: np.ndarray) -> np.ndarray:
    """Each key's slot; a key that wasn't built in gets any slot, or -1."""
    found, base = np.full(len(keys), -1, np.int64), 0
    open_ = np.arange(len(keys))
    for level, size in enumerate(mph["sizes"]):
        at = base + _place(keys[open_], level, size)
        hit = mph["bits"][at]
        found[open_[hit]] = mph["rank"][at[hit]]
        open_, base = open_[~hit], base + size
    if len(mph["rest"]) and len(open_):  # the few that no level could hold
        at = np.minimum(np.searchsorted(mph["rest"], keys[open_]), len(mph["rest"]) - 1)
        same = mph["rest"][at] == keys[open_]
        found[open_[same]] = int(mph["bits"].sum()) + at[same]
    return found


def pack(keys: np.ndarray, prints: np.ndarray, counts: np.ndarray, last: np.ndarray) -> dict:
    """The shard's bytes: bit levels, and the arrays in slot order."""
    mph = build(keys)
    order = np.argsort(slots(mph, keys))
    return {
        "sizes": np.array(mph["sizes"], np.int64).tobytes(), "bits": np.packbits(mph["bits"]).tobytes(), "rest": mph["rest"].tobytes(),
        "prints": prints[order].tobytes(), "counts": counts[order].astype(np.int64).tobytes(), "last": last[order].astype(np.int64).tobytes(),
    }


def unpack(row) -> dict:
    sizes = np.frombuffer(row["sizes"], np.int64).tolist()
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
    arrays = {"prints": np.frombuffer(row["prints"], np.uint64), "counts": np.frombuffer(row["counts"], np.int64), "last": np.frombuffer(row["last"], np.int64)}
    return arrays | {"bits": bits, "sizes": sizes, "rank": np.cumsum(bits, dtype=np.int64) - 1, "rest": np.frombuffer(row["rest"], np.uint64)}


def probe(shard: dict, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """The largest holding doc_id of each key the shard has, else -2**63."""
    out = np.full(len(keys), np.iinfo(np.int64).min)
    if not len(shard["prints"]):
        return out
    at = slots(shard, keys)
    hit = at >= 0
    hit[hit] = shard["prints"][at[hit]] == prints[hit]
    out[hit] = shard["last"][at[hit]]
    return out


# -- jobs -------------------------------------------------------------------------------

_ARRAYS = "shard int, sizes binary, bits binary, rest binary, prints binary, counts binary, last binary"
_NONE = np.iinfo(np.int64).min


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h, print, n_docs, last): each long line key, its documents and the largest of them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                keys = {digest(k) for k in line_keys(text or "") if _long(k, min_chars)}
                ids += [doc_id] * len(keys)
                found += keys
            both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc_id", "h", "print"])

    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(emit, "doc_id long, h long, print long")
    return rows.distinct().groupBy("h", "print").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("last"))


def index(counts: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The packed shards of all keys found in min_docs documents or more, and how many shards there are."""
    common = cut(counts.where(F.col("n_docs") >= min_docs))
    shards = max(1, -(-common.count() // shard_keys))

    def arrays(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = pack(rows["h"].to_numpy().view(np.uint64), rows["print"].to_numpy().view(np.uint64), rows["n_docs"].to_numpy(), rows["last"].to_numpy())
        return pd.DataFrame({"shard": [key[0]]} | {k: [v] for k, v in made.items()})

    packed = common.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(arrays, _ARRAYS)
    return cut(packed), shards


def _rewrite(text: str | None, doc_id: int | None, last: dict[bytes, int], min_chars: int) -> tuple[str, int, int]:
    lines = (text or "").split("\n")
    if not last:
        return text or "", len(lines), 0
    kept = [line for line, key in zip(lines, line_keys(text or ""), strict=True) if not (_long(key, min_chars) and last.get(digest(key), doc_id) != doc_id)]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All columns of docs with text rewritten, and n_lines, n_dropped.

    A line's key is the line with ASCII blanks stripped and A-Z lower-cased. Keys of at
    least min_chars code points found in at least min_docs distinct doc_ids lose all their
    lines except in the largest doc_id that holds them (all of that document's copies stay).
    A null text is one empty line and becomes empty; a null doc_id holds no line and loses
    none; repeated rows with one doc_id count once and are rewritten alike. Other columns
    pass through.
    """
    packed, shards = index(line_counts(docs, min_chars), min_docs, shard_keys)
    size = packed.agg(F.coalesce(F.sum(sum(F.length(c) for c in ("bits", "rest", "prints", "counts", "last"))), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        return _by_broadcast(docs, packed, shards, min_chars)
    return _by_routing(docs, packed, shards, min_chars)


def _by_broadcast(docs: DataFrame, packed: DataFrame, shards: int, min_chars: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast({r["shard"]: r.asDict() for r in packed.collect()})
    schema = docs.schema

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = {k: unpack(r) for k, r in sent.value.items()}
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            keys = [digest(k) for i, t in zip(ids, texts, strict=True) if i is not None for k in line_keys(t or "") if _long(k, min_chars)]
            last: dict[bytes, int] = {}
            if keys and arrays:
                both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                shard = both[:, 0] % shards
                for s in np.unique(shard).tolist():
                    if s in arrays:
                        mine = np.flatnonzero(shard == s)
                        held = probe(arrays[s], both[mine, 0].view(np.uint64), np.ascontiguousarray(both[mine, 1]).view(np.uint64))
                        last |= {keys[mine[k]]: int(held[k]) for k in np.flatnonzero(held != _NONE)}
            done = [_rewrite(t, i, last if i is not None else {}, min_chars) for i, t in zip(ids, texts, strict=True)]
            yield _with(batch, done)

    return docs.mapInArrow(rewrite, _out(schema))


def _by_routing(docs: DataFrame, packed: DataFrame, shards: int, min_chars: int, route_rows: int = ROUTE_ROWS) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(i, digest(k)) for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) if i is not None for k in line_keys(t or "") if _long(k, min_chars)}
            both = np.frombuffer(b"".join(k for _, k in found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array((both[:, 0] % shards).astype(np.int32))], ["doc_id", "h", "print", "shard"])

    def answer(key: tuple, rows: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(arrays):
            return pd.DataFrame({"doc_id": np.zeros(0, np.int64), "h": np.zeros(0, np.int64), "print": np.zeros(0, np.int64)})
        held = probe(unpack(arrays.iloc[0]), rows["h"].to_numpy().view(np.uint64), rows["print"].to_numpy().view(np.uint64))
        return rows.loc[(held != _NONE) & (held != rows["doc_id"].to_numpy()), ["doc_id", "h", "print"]]

    probes = cut(docs.select("doc_id", "text").mapInArrow(ask, "doc_id long, h long, print long, shard int"))
    parts = F.broadcast(hot(probes, "shard", route_rows))  # the shard of a very common line is copied to as many tasks as its probes need
    probes = probes.join(parts, "shard", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), "_parts"), F.lit(0)).cast("int")).drop("_parts")
    held = packed.join(parts, "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    gone = probes.groupBy("shard", "salt").cogroup(held.groupBy("shard", "salt")).applyInPandas(answer, "doc_id long, h long, print long")
    lost = cut(gone.groupBy("doc_id").agg(F.collect_set(F.struct("h", "print")).alias("_lost")))
    marks = bit_table(lost, F.col("doc_id"))  # documents that lose nothing are told by it and stay where they lie
    schema = docs.schema

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, gone in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["_lost"].to_pylist(), strict=True):
                last = {np.array([x["h"], x["print"]], np.int64).tobytes(): None for x in gone or []}
                out.append(_rewrite(text, doc_id, last, min_chars))
            yield _with(batch.drop_columns(["_lost"]), out)

    told = marked(docs, F.col("doc_id"), marks, live="_live")
    losing = told.where(F.col("_live") & F.col("doc_id").isNotNull()).join(lost, "doc_id", "left").select(*docs.columns, "_lost")
    whole = told.where(~F.col("_live") | F.col("doc_id").isNull()).select(*docs.columns, F.lit(None).cast(lost.schema["_lost"].dataType).alias("_lost"))
    return losing.unionByName(whole).mapInArrow(rewrite, _out(schema))


def _out(schema: StructType) -> StructType:
    return StructType([f for f in schema.fields if f.name not in ("n_lines", "n_dropped")] + [StructField("n_lines", LongType()), StructField("n_dropped", LongType())])


def _with(batch: pa.RecordBatch, done: list[tuple[str, int, int]]) -> pa.RecordBatch:
    """The batch with its new texts; a clashing n_lines or n_dropped column of the input is replaced."""
    columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in ("n_lines", "n_dropped")}
    columns["text"] = pa.array([d[0] for d in done], batch.schema.field("text").type)
    columns |= {"n_lines": pa.array([d[1] for d in done], pa.int64()), "n_dropped": pa.array([d[2] for d in done], pa.int64())}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         lower_ascii AS key, length(lower_ascii) AS n
  FROM (SELECT doc_id, pos, line,
               translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
        FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))),
keys AS (SELECT key, max(doc_id) AS last FROM lines WHERE n >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT lines.*, (keys.key IS NOT NULL AND keys.last <> doc_id) AS gone FROM lines LEFT JOIN keys USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
