"""Prefilter of a wide table by the keys of another: a bitmap of fixed size, made and probed by Spark.

The keys become positions in ``2 ** BITS`` bits, held as a table of at most ``2 ** BITS / 32768`` rows of 4 KiB, so it
may be broadcast whatever the number of keys.  Rows whose bit is not set cannot have a key; the others still have
to be joined.  More keys make the filter less selective, never wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 23
MANY_BITS = 25  # 4 MB, for a key a parish


def _position(key: Column, size: int) -> Column:
    """1 .. 2 ** size, as the bitmap functions count."""
    return F.pmod(F.xxhash64(key), F.lit(1 << size)) + 1


def key_bits(keys: DataFrame, key: str, size: int | None = None) -> DataFrame:
    """(bucket, bits) of the keys."""
    at = keys.select(_position(F.col(key), size or BITS).alias("at"))
    return (at.groupBy(F.bitmap_bucket_number("at").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")))


def with_likely(df: DataFrame, keys: DataFrame, key: str, other: str | None = None, name: str = "likely",
                size: int | None = None) -> DataFrame:
    """``df`` plus a boolean: false only where no row of ``keys`` has the key (in its column ``other``)."""
    bits = key_bits(keys, other or key, size).select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
    placed = df.withColumn("__at", _position(F.col(key), size or BITS))
    joined = placed.join(F.broadcast(bits), F.bitmap_bucket_number("__at") == F.col("__bucket"), "left")
    place = F.bitmap_bit_position("__at")
    byte = F.conv(F.hex(F.substring("__bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (place % 8).cast("int")) == 1
    return joined.withColumn(name, F.coalesce(is_set, F.lit(False))).drop("__at", "__bucket", "__bits")


def likely(df: DataFrame, keys: DataFrame, key: str, other: str | None = None, size: int | None = None) -> DataFrame:
    """The rows of ``df`` whose key may be among ``keys``."""
    return with_likely(df, keys, key, other, "__likely", size).where("__likely").drop("__likely")
