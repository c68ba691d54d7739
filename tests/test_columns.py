"""Column helpers against the reference engine (DuckDB) on random input."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType, TimestampNTZType

from deliverix.functions.columns import (
    day_diff, day_of_week, month_diff, month_start, round_half_away, week_diff, week_start,
)


def test_round_half_away_matches_duckdb(spark):
    rnd = random.Random(7)
    vals = [round(rnd.uniform(-1000, 1000), rnd.choice([2, 3, 4])) for _ in range(3000)]
    vals += [1.005, 0.285, 2.675, -0.125, 0.5, 1.5, -2.5, 1e-9, 123456.785]
    df = spark.createDataFrame([(v,) for v in vals], StructType([StructField("x", DoubleType())]))
    got = {n: [r[0] for r in df.select(round_half_away("x", n)).collect()] for n in (0, 1, 2)}
    con = duckdb.connect()
    for n in (0, 1, 2):
        exp = [r[0] for r in con.execute(
            f"SELECT round(x, {n}) FROM unnest(?::DOUBLE[]) t(x)", [vals]).fetchall()]
        assert got[n] == exp


def test_fixed_rounding_cases(spark):
    r = spark.range(1).select(round_half_away(F.lit(1.005), 2).alias("a"),
                              round_half_away(F.lit(0.285), 2).alias("b")).first()
    assert (r.a, r.b) == (1.0, 0.28)


def test_calendar_helpers_match_duckdb(spark):
    rnd = random.Random(11)
    base = dt.datetime(2015, 1, 1)
    pairs = []
    for _ in range(2000):
        a = base + dt.timedelta(minutes=rnd.randrange(0, 6 * 365 * 24 * 60))
        b = a + dt.timedelta(minutes=rnd.randrange(-400 * 24 * 60, 400 * 24 * 60))
        pairs.append((a, b))
    pairs += [(dt.datetime(2024, 1, 7, 23), dt.datetime(2024, 1, 8, 1)),
              (dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 1)),
              (dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 8, 9))]
    schema = StructType([StructField("a", TimestampNTZType()), StructField("b", TimestampNTZType())])
    df = spark.createDataFrame(pairs, schema)
    got = [tuple(r) for r in df.select(
        day_diff("a", "b"), week_diff("a", "b"), month_diff("a", "b"),
        week_start("a"), month_start("a"), day_of_week("a")).collect()]
    con = duckdb.connect()
    con.register("p", __import__("pandas").DataFrame(pairs, columns=["a", "b"]))
    exp = [tuple(r) for r in con.execute("""
        SELECT date_diff('day', a, b), date_diff('week', a, b), date_diff('month', a, b),
               date_trunc('week', a), date_trunc('month', a), extract('dow' FROM a) FROM p""").fetchall()]
    assert got == exp


@pytest.mark.parametrize("a,b,weeks", [
    ("2024-01-07", "2024-01-08", 0),   # Sunday -> Monday
    ("2024-01-01", "2024-01-08", 1),
    ("2024-01-08 10:00", "2024-01-01 09:00", -1),
])
def test_week_diff_semantics(spark, a, b, weeks):
    r = spark.range(1).select(week_diff(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"))).first()
    assert r[0] == weeks
