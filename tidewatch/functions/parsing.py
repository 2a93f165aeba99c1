"""Tolerant parsing of report fields: what can't be read becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first three digits of an MMSI and its flag.
FLAGS = {
    "563": "SG", "564": "SG", "565": "SG", "566": "SG", "525": "ID", "533": "MY", "567": "TH", "574": "VN", "412": "CN", "413": "CN", "414": "CN",
    "431": "JP", "432": "JP", "440": "KR", "441": "KR", "366": "US", "367": "US", "368": "US", "369": "US", "338": "US", "273": "RU", "422": "IR",
}


def number(x: Column) -> Column:
    return x.try_cast("double")


def text(x: Column) -> Column:
    trimmed = F.trim(x)
    return F.when(trimmed != "", trimmed)


def timestamp(x: Column) -> Column:
    """Date and time parted by T or a blank, in UTC."""
    return F.coalesce(F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm:ss")))


def live_timestamp(x: Column) -> Column:
    """The stream's form with a fraction and an offset; without a fraction it can't be read."""
    return F.try_to_timestamp(F.when(x.contains("."), F.substring_index(x, ".", 1)), F.lit("yyyy-MM-dd HH:mm:ss"))


def below(x: Column, limit: float) -> Column:
    """The value unless it is a sentinel at or above limit."""
    return F.when(x < limit, x)


def coordinate(x: Column, low: float, high: float) -> Column:
    return F.when(~F.isnan(x) & x.between(low, high), x)


# Ranges of type codes and their categories.
def ship_type(code: Column) -> Column:
    n = code.try_cast("double").cast("int")
    by_decade = F.when(n == 30, "fishing").when(n.between(31, 39), "special").when(n.between(60, 69), "passenger").when(n.between(70, 79), "cargo").when(n.between(80, 89), "tanker")
    return by_decade.when(n == 52, "tug").when(n.isNotNull(), "other")


def flag(mmsi: Column) -> Column:
    pairs = [F.lit(x) for pair in FLAGS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.substring(F.trim(mmsi), 1, 3))
