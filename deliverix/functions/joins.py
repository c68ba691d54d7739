"""Joins with one-row sides; rows without a partner left out before a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of :func:`key_bits`; a fixed number, so that the broadcast has 4 MB of bitmaps at most.
BITS = 1 << 25


def cross_one_row(left: DataFrame, *one_row: DataFrame) -> DataFrame:
    """Attach one-row frames (global aggregates, ``limit(1)``) to ``left``.

    Each one-row side is broadcast explicitly: its size is fixed by
    construction, and without the hint a side with unknown statistics would
    turn the cross join into a cartesian product of partitions.
    """
    out = left
    for df in one_row:
        out = out.crossJoin(F.broadcast(df))
    return out


def key_bits(df: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """(bucket, bits): a bitmap of the hashes of the values of ``key``, for :func:`likely_partners`."""
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    return df.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))


def likely_partners(df: DataFrame, key: str, partners: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be among the keys of ``partners`` (:func:`key_bits` of a column of the same type).

    No row with a partner is lost; one without stays if its hash meets another
    key's, so the join still has to follow.  Its shuffle is spared most of the
    others until the keys are far more than the bits.
    """
    columns = df.columns
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    df = df.withColumns({"_bucket": F.bitmap_bucket_number(place), "_bit": F.bitmap_bit_position(place)})
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return df.join(F.broadcast(partners), "_bucket").where(F.getbit(byte, F.col("_bit").bitwiseAND(7).cast("int")) == 1).select(*columns)
