"""Exact duplicates by progressive refinement: length, then a prefix's hash, then the full hash.

Each level reads the texts where they lie and marks the keys that more than one row has in a
bit table of fixed size, which is broadcast: rows whose bit isn't set have no equal and are
never looked at more closely. The bit table only spares work. Two keys that share a bit
let rows through that the next level tells apart, so results are the same at any fill.
Rows that pass both levels are hashed as a whole; what travels afterwards is a digest a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import cut, looked_up, table

PREFIX = 64  # code points of the second level
BITS = 1 << 27  # 16 MB
_BLANKS = r"[ \t-\r]+"
_OUT = ("keep_id", "group_size", "kept", "text_sha256")


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def repeated_keys(rows: DataFrame, key: Column, bits: int = BITS) -> DataFrame:
    """(block, marks): a bitmap of the slots that two or more rows' keys fall into; at most bits / 32,768 rows of 4 kB."""
    slots = rows.select(_slot(key, bits).alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    return cut(slots.groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("marks")))


def bit_table(rows: DataFrame, key: Column, bits: int = BITS) -> DataFrame:
    """(block, marks): a bitmap of the slots that any row's key falls into."""
    slots = rows.select(_slot(key, bits).alias("slot"))
    return cut(slots.groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("marks")))


def marked(rows: DataFrame, key: Column, marks: DataFrame, bits: int = BITS, live: str = "live") -> DataFrame:
    """The rows whose key's slot is marked have a column live of true, the others of false."""
    placed = rows.withColumn("_slot", _slot(key, bits)).withColumn("_block", F.bitmap_bucket_number("_slot")).withColumn("_bit", F.bitmap_bit_position("_slot"))
    one = F.expr("cast(conv(hex(substring(_marks, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)")
    set_ = F.expr("cast(_bit % 8 as int)")
    held = F.broadcast(marks.select(F.col("block").alias("_block"), F.col("marks").alias("_marks")))
    out = placed.join(held, "_block", "left").withColumn(live, F.coalesce(F.getbit(one, set_) == 1, F.lit(False)))
    return out.drop("_block", "_marks", "_slot", "_bit")


def exact_duplicates(docs: DataFrame, carry: Sequence[str] = (), digests: bool = False, prefix: int = PREFIX, bits: int = BITS) -> DataFrame:
    """doc_id, the carried columns, keep_id, group_size, kept and text_sha256 for each row of docs.

    Texts are equal when identical without the characters [\\x20\\x09-\\x0D]; null counts as
    empty, and empty texts are equal to each other. Of equal texts the row with the most code
    points stays, then the one with the smallest doc_id (a null doc_id comes last), and one
    of rows that repeat both: group_size counts rows, exactly one row of a group is kept.
    keep_id is null where the row that stays has no doc_id. text_sha256 is the full hash of the
    text without blanks, null for rows that an earlier level found to be alone unless digests
    asks for all. Other columns aren't read, so their names don't matter; a carried one must
    not have the name of a result. An empty table gives no rows.
    """
    if clash := set(carry) & {"doc_id", *_OUT}:
        raise ValueError(f"carried columns have names of results: {sorted(clash)}")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.struct(*[F.col(c) for c in carry]).alias("_carried") if carry else F.lit(None).cast("int").alias("_carried"), F.length(text).alias("_chars"), F.regexp_replace(text, _BLANKS, "").alias("_text"))
    rows = rows.withColumn("_length", F.length("_text"))
    by_length, by_prefix = F.col("_length"), F.struct("_length", F.left(F.col("_text"), F.lit(prefix)))
    lengths = repeated_keys(rows, by_length, bits)
    first = marked(rows, by_length, lengths, bits)
    prefixes = repeated_keys(first.where("live"), by_prefix, bits)
    second = marked(first.withColumnRenamed("live", "_live"), by_prefix, prefixes, bits).withColumn("_live", F.col("_live") & F.col("live"))
    full = F.sha2("_text", 256)
    found = cut(second.select("doc_id", "_carried", "_chars", "_live", (full if digests else F.when(F.col("_live"), full)).alias("text_sha256"), F.monotonically_increasing_id().alias("_row")))
    order = F.struct((-F.col("_chars")).alias("chars"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "_row")
    groups = cut(found.where("_live").groupBy("text_sha256").agg(F.count("*").alias("_n"), F.min(order).alias("_best")).where("_n > 1"))
    shared = looked_up(found.where("_live"), groups, "text_sha256", F.col("_row"), "left")
    alone = found.where("NOT _live").withColumn("_n", F.lit(1).cast("long")).withColumn("_best", F.lit(None).cast(groups.schema["_best"].dataType))
    in_group = F.col("_best").isNotNull()
    return shared.unionByName(alone).select(
        "doc_id", *[F.col("_carried")[c].alias(c) for c in carry],
        F.when(in_group, F.col("_best")["doc_id"]).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"),
        F.when(in_group, F.col("_best")["_row"] == F.col("_row")).otherwise(F.lit(True)).alias("kept"), "text_sha256",
    )


def op12_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), digests=True)


OP12_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS x FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY x) AS group_size, row_number() OVER w = 1 AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x ORDER BY chars DESC, doc_id NULLS LAST)
"""
