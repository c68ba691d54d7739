"""Joins that grow with the data: bitmaps of keys, and no broadcast by the bytes of compressed files."""

from pyspark.sql import functions as F

from deliverix.functions.joins import key_bits, likely_partners
from deliverix.plans.build import Build, build_for
from deliverix.sources.testdata import load_testdata

SF = "/root/testdata/sf0.01"


def test_likely_partners_lose_no_partner(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 100 != 99, F.concat(F.lit("o"), "id")).alias("k"), "id")
    some = rows.where("id % 7 = 0").unionByName(rows.where("id % 14 = 0"))  # repeated keys and null ones
    want = {r.id for r in rows.join(some.select("k").distinct(), "k").collect()}
    for bits in (1 << 25, 1 << 15, 64):  # few bits are full, and let all rows through
        got = [r.id for r in likely_partners(rows, "k", key_bits(some, "k", bits), bits).collect()]
        assert len(got) == len(set(got)) and want <= set(got), bits
    got = likely_partners(rows, "k", key_bits(some, "k"))
    assert got.columns == ["k", "id"] and got.count() < 1.1 * len(want)
    assert likely_partners(rows, "k", key_bits(some.limit(0), "k")).count() == 0


def test_growing_sides_are_not_broadcast(spark):
    """Their files are a few compressed bytes a row, so an estimate from these lets far too many rows through."""
    b = build_for(spark, SF)
    plan = Build(spark, b.t, b.params, persist=False).lines._jdf.queryExecution().executedPlan().toString()
    orders = load_testdata(spark, SF).orders._jdf.queryExecution().executedPlan().toString()
    for key, text in (("product_id", plan), ("order_id", plan), ("o_orderkey", orders)):
        assert f"BroadcastHashJoin [{key}" not in text and f"SortMergeJoin [{key}" in text, (key, text)


def test_lines_of_other_orders_are_not_shuffled(spark):
    b = build_for(spark, SF)
    c = Build(spark, b.t, b.params, materialize="table")
    clean = c.core.select("order_id")
    assert c._core_bits is not None
    kept = likely_partners(b.t.items, "order_id", c._core_bits)
    assert kept.count() < 1.1 * b.t.items.join(clean, "order_id", "left_semi").count() < 0.6 * b.t.items.count()
    want = Build(spark, b.t, b.params, persist=False)
    columns = c.lines.columns
    assert c.lines.exceptAll(want.lines.select(columns)).isEmpty() and c.lines.count() == want.lines.count()
