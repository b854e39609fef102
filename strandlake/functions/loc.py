"""Locations (1-based, inclusive; strand 1, -1 or 0) and qualifier lists of annotation features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def envelope(location: Column) -> Column:
    """struct<start, end, strand> around all segments: the strand only if they agree, otherwise 0; null if there are none."""
    strands = F.array_distinct(F.transform(location, lambda x: x["strand"]))
    strand = F.when((F.size(strands) == 1) & F.get(strands, F.lit(0)).isNotNull(), F.get(strands, F.lit(0))).otherwise(F.lit(0)).cast("tinyint")
    box = F.struct(F.array_min(F.transform(location, lambda x: x["start"])).alias("start"), F.array_max(F.transform(location, lambda x: x["end"])).alias("end"), strand.alias("strand"))
    return F.when(F.size(location) > 0, box)


def values_of(qualifiers: Column, key: str) -> Column:
    """All values of the first qualifier of that key, null if there is none."""
    return F.get(F.filter(qualifiers, lambda q: q["key"] == F.lit(key)), F.lit(0))["values"]


def qualifier(qualifiers: Column, key: str) -> Column:
    return F.get(values_of(qualifiers, key), F.lit(0))


def other_qualifiers(qualifiers: Column, *keys: str) -> Column:
    return F.filter(qualifiers, lambda q: ~q["key"].isin(*keys))


def numeric_qualifier(qualifiers: Column, key: str, type_: str = "tinyint") -> Column:
    return qualifier(qualifiers, key).try_cast(type_)


def strand_of(sign: Column) -> Column:
    return F.when(sign == "+", 1).when(sign == "-", -1).otherwise(0).cast("tinyint")
