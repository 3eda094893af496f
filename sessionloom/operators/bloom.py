"""Bloom filters of 64-bit keys as rows of bitmaps, built and merged by Spark's bitmap aggregates.

A filter is a row for each bucket of 32 768 bits that has any: (owner, bucket, bitmap). Filters of the same size merge by
``bitmap_or_agg``. All of an owner's rows are small beside its keys: 12 bits a key at the size below for a million keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter, and how many each key sets: of a million keys, another key passes with probability below 0.01.
BITS, HASHES = 12 << 20, 6
FILTER = "owner int, bucket long, bitmap binary"


def _spots(key: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(k)), F.lit(BITS)) + 1 for k in range(HASHES)])


def build(keys: DataFrame, owner: Column, key: str = "_key") -> DataFrame:
    """One filter for each owner of ``keys``."""
    spots = keys.select(owner.cast("int").alias("owner"), F.explode(_spots(F.col(key))).alias("spot"))
    return spots.groupBy("owner", F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bitmap"))


def merge(filters: DataFrame, owner: Column) -> DataFrame:
    """The filter of all keys of several filters."""
    return filters.groupBy(owner.cast("int").alias("owner"), "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def candidates(keys: DataFrame, filters: DataFrame, key: str = "_key") -> DataFrame:
    """(key, owner) for each owner whose filter may hold the key. Keys that the merged filter excludes meet no other."""
    asked = keys.select(key).distinct()
    some = _passing(asked, merge(filters, F.lit(0)), key).select(key)
    return _passing(some, filters, key)


def _passing(keys: DataFrame, filters: DataFrame, key: str) -> DataFrame:
    spots = keys.select(key, F.explode(_spots(F.col(key))).alias("spot"))
    spots = spots.select(key, "spot", F.bitmap_bucket_number("spot").alias("bucket"), F.bitmap_bit_position("spot").cast("int").alias("bit"))
    byte = F.conv(F.hex(F.substring("bitmap", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.expr("(_byte >> (bit % 8)) & 1") == 1
    met = spots.join(filters, "bucket").withColumn("_byte", byte).where(held)
    want = keys.select(key, F.size(F.array_distinct(_spots(F.col(key)))).alias("_n"))
    found = met.groupBy(key, "owner").agg(F.count_distinct("spot").alias("_hit"))
    return found.join(want, key).where("_hit = _n").select(key, "owner")
