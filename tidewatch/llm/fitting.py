"""Bounded samples of labelled documents for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.llm.tables import cut

MAX_BYTES = 64 << 20


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the decimal doc_id modulo modulus."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def sample_ids(labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """(doc_id, y) of about most usable labelled rows, drawn by a hash of doc_id; all of them where there are fewer.

    Rows without a label or doc_id are left out; of repeated doc_ids the largest label counts.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = rows.count()
    if n <= most:
        return rows
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30))
    return rows.where(place < int(most / n * (1 << 30)))


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int, most_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, y, text) of about most usable labelled documents, in the order of a hash up to most_bytes of text.

    A doc_id stands once, however many rows repeat it (the text with the least hash); texts
    are whole or not in the sample, one longer than what is left of most_bytes isn't. Only
    these rows reach the driver.
    """
    ids = F.broadcast(sample_ids(labels, label, usable, most))
    text = F.coalesce("text", F.lit(""))
    sizes = docs.join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64(text).alias("h"), F.octet_length(text).alias("n"))).alias("m"))
    sizes = cut(sizes.select("doc_id", "y", "m.h", "m.n"))  # about most rows of a few bytes
    taken = sizes.where(F.col("n") <= most_bytes // 4).withColumn("upto", F.sum("n").over(W.orderBy(F.xxhash64("doc_id", F.lit("order")), "doc_id"))).where(F.col("upto") <= most_bytes)
    rows = docs.select("doc_id", text.alias("text")).withColumn("h", F.xxhash64("text")).join(F.broadcast(taken.select("doc_id", "y", "h")), ["doc_id", "h"])
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
