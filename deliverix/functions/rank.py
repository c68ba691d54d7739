"""Ranks that stay distributed.

A window without PARTITION BY moves every row into one task.  Here values are
cut into ranges of about equal numbers at splitters sampled from the data
(:func:`with_ranges`); ranges are ordered in tasks of their own and get the
number of rows before them from the counts per range, a few thousand rows.
:func:`first_by_key` orders only the one range in which the cut lies.
Nothing runs before a result is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deliverix.functions.joins import cross_one_row

#: Ranges that values are cut into.
RANGES = 4096
_BUCKETS = 1 << 30


def _splitters(df: DataFrame, key: str, ranges: int) -> DataFrame:
    """One row: about ``ranges`` different keys in order (all, if there are fewer), chosen by their hashes.

    The choice depends on the keys alone, not on how they are partitioned, and
    keeps up with any distribution: each range between two splitters is expected
    to hold the same number of keys.
    """
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    kept = F.pmod(F.xxhash64(F.lit(17), key), F.lit(_BUCKETS)).cast("double") * F.col("_n").cast("double") <= F.lit(float(ranges) * _BUCKETS)
    return cross_one_row(df.select(key), n).where(kept).agg(F.array_sort(F.collect_set(key)).alias("_splitters"))


def with_ranges(df: DataFrame, key: str, ranges: int = RANGES, of: str = "_range") -> DataFrame:
    """Adds ``of``, the number of splitters up to a row's key; it never decreases with the key.

    Splitters are looked up in two steps of about the root of their number.
    """
    wide = max(1, round(ranges ** 0.5))
    cut = _splitters(df, key, ranges).select(
        "_splitters", F.transform(F.sequence(F.lit(0), F.floor(F.size("_splitters") / wide).cast("int")),
                                  lambda i: F.slice("_splitters", i * wide + 1, F.lit(wide))).alias("_slices"))
    cut = cut.select("_slices", F.transform(F.filter("_slices", lambda s: F.size(s) == wide), lambda s: F.element_at(s, -1)).alias("_last"))
    rows = cross_one_row(df, cut)
    coarse = F.size(F.filter("_last", lambda s: s <= F.col(key)))
    rows = rows.withColumn("_coarse", coarse)
    fine = F.size(F.filter(F.get("_slices", F.col("_coarse")), lambda s: s <= F.col(key)))
    return rows.withColumn(of, (F.col("_coarse") * wide + F.coalesce(fine, F.lit(0))).cast("int")).drop("_slices", "_last", "_coarse")


def avg_pct_rank(df: DataFrame, value: str, out: str, source: DataFrame | None = None) -> DataFrame:
    """Percent rank with ties sharing their average rank (pandas ``rank(pct=True)``).

    pct = (rows below + (ties + 1) / 2) / non-null rows; NULL values get NULL.
    ``source``: a frame with the same rows from which the values are cheaper to read.
    """
    counts = (df if source is None else source).where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_ties"))
    counts = with_ranges(counts, value)
    per = counts.groupBy("_range").agg(F.sum("_ties").alias("_rows"))
    per = per.select("_range", F.coalesce(F.sum("_rows").over(_before("_range")), F.lit(0)).alias("_offset"),
                     F.sum("_rows").over(Window.partitionBy()).alias("_all"))
    below = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.join(F.broadcast(per), "_range").select(
        value,
        (
            ((F.col("_offset") + F.coalesce(F.sum("_ties").over(below), F.lit(0))).cast("double")
             + (F.col("_ties").cast("double") + F.lit(1.0)) / F.lit(2.0))
            / F.col("_all").cast("double")
        ).alias(out),
    )
    return df.join(counts, on=value, how="left")


def dense_code(df: DataFrame, value: str, out: str) -> DataFrame:
    """0-based alphabetical code of ``value`` (pandas category codes)."""
    codes = with_ranges(df.select(value).where(F.col(value).isNotNull()).distinct(), value)
    per = codes.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    per = per.select("_range", F.coalesce(F.sum("_rows").over(_before("_range")), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(value)) - 1
    codes = codes.join(F.broadcast(per), "_range").select(value, (F.col("_offset") + place).cast("bigint").alias(out))
    return df.join(codes, on=value, how="left")


def _before(key: str) -> Window:
    """All earlier ranges: a window over one row per range."""
    return Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)


def first_by_key(df: DataFrame, key: str, take: Column, ranges: int = RANGES) -> DataFrame:
    """The ``take`` rows with the smallest ``key`` (unique, not null); ``take`` is the same on all rows.

    Counts per range say which ranges are taken whole; only the range in which
    the cut lies, about one in ``ranges`` of the rows whatever the keys look like,
    is ordered row by row.
    """
    rows = with_ranges(df.withColumn("_left", take.cast("long")), key, ranges)
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_in_range"), F.first("_left").alias("_wanted"))
    counts = counts.select("_range", "_in_range", (F.col("_wanted") - F.coalesce(F.sum("_in_range").over(_before("_range")), F.lit(0))).alias("_still"))
    rows = rows.join(F.broadcast(counts.where(F.col("_still") > 0)), on="_range", how="inner")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    cut = rows.where(F.col("_in_range") > F.col("_still")).withColumn("_rn", place).where(F.col("_rn") <= F.col("_still"))
    whole = rows.where(F.col("_in_range") <= F.col("_still"))
    return whole.select(*df.columns).unionByName(cut.select(*df.columns))
