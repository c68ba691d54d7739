"""Hot keys: one customer, one order, one product and one seller hold a large
share of the rows.  With AQE's skew handling forced on (tiny thresholds) the
results must equal those of a plan without it."""

import random
import tempfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from deliverix.params import Params
from deliverix.plans.build import Build
from deliverix.sources import csv_ingest
from market_fixtures import customer, item, order, product, tables

P = Params(min_category_orders=1, min_seller_orders=1, min_lane_shipments=1, min_corridor_shipments=1,
           min_month_orders=1, cohort_start="2017-01-01")
JOBS = ["lead_category", "seller", "cohort", "volume", "velocity", "freight", "bottom", "ltv"]


def _skewed_tables(spark):
    rnd = random.Random(1)
    orders, items = [], []
    for i in range(600):
        cust = "hot" if i % 3 == 0 else f"c{i % 50}"
        day = 1 + i % 27
        month = 1 + (i // 27) % 12
        orders.append(order(f"o{i}", cust, f"2018-{month:02d}-{day:02d} 10:00:00",
                            f"2018-{month:02d}-{day:02d} 23:00:00" if i % 5 else f"2019-01-{day:02d} 10:00:00",
                            f"2018-{month:02d}-28 00:00:00"))
        n_lines = 40 if i == 7 else 1 + i % 3          # one order with many lines
        for k in range(n_lines):
            seller = "s_hot" if rnd.random() < 0.34 else f"s{rnd.randint(1, 9)}"
            prod = "p_hot" if rnd.random() < 0.34 else f"p{rnd.randint(1, 20)}"
            items.append(item(f"o{i}", k + 1, prod, seller, round(rnd.uniform(1, 100), 2),
                              round(rnd.uniform(0, 10), 2)))
    customers = [customer("hot")] + [customer(f"c{j}", state=f"S{j % 5}") for j in range(50)]
    products = [product("p_hot", "cat_hot")] + [product(f"p{j}", f"cat{j % 4}") for j in range(1, 21)]
    sellers = [("s_hot", "x", "SP")] + [(f"s{j}", "y", f"S{j % 3}") for j in range(1, 10)]
    reviews = [(f"o{i}", 1 + i % 5) for i in range(0, 600, 2)]
    return tables(spark, orders, customers, items, products, [("cat0", "zero")], sellers, reviews)


@pytest.fixture()
def skew_conf(spark):
    keys = {
        # no broadcasts: all four joins of the line table meet the hot keys
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in keys}
    yield keys
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_keys_same_results(spark, skew_conf):
    t = _skewed_tables(spark)
    results = {}
    for mode in ("skew", "plain"):
        for k, v in skew_conf.items():
            spark.conf.set(k, v)
        if mode == "plain":
            spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
        b = Build(spark, t, P, persist=False)
        if mode == "skew":
            lines = b.lines
            lines.collect()
            plan = lines._jdf.queryExecution().executedPlan().toString()
            # customer, order, product and seller joins are all split
            assert plan.count("SortMergeJoin(skew=true)") >= 3, plan
        results[mode] = {j: sorted(map(tuple, getattr(b, j).collect()), key=repr) for j in JOBS}
    for j in JOBS:
        assert results["skew"][j] == results["plain"][j], j
    assert any(r[0] == "s_hot" for r in results["skew"]["seller"])


def _with_hot_order(spark):
    """One order holds a third of all lines."""
    t = _skewed_tables(spark)
    n = t.items.where("order_id <> 'o7'").count()
    lines = [item("o7", k + 1, f"p{k % 20 + 1}", f"s{k % 9 + 1}", 1.0 + k % 90, k % 7 / 2) for k in range(n // 2)]
    more = tables(spark, [], [], lines, [], [], [], []).items
    return replace(t, items=t.items.where("order_id <> 'o7'").unionByName(more))


def test_hot_order_in_bucketed_tables(spark):
    """The hot order's lines are set apart at ingest and joined by broadcast; the buckets hold the rest."""
    t = _with_hot_order(spark)
    assert 3 * t.items.where("order_id = 'o7'").count() >= t.items.count() - 2
    root = tempfile.mkdtemp(prefix="deliverix-hot-")
    geo = t.customers.select(F.col("customer_city").alias("geolocation_city"), F.col("customer_state").alias("geolocation_state")).limit(1)
    csv_ingest.export_raw_csv(t, geo, f"{root}/raw")
    res = csv_ingest.ingest_csv(spark, f"{root}/raw", f"{root}/tables", order_buckets=8, table_prefix="hot")
    assert {r.order_id for r in res.hot_items.collect()} == {"o7"}
    assert res.bucketed_items.where("order_id = 'o7'").count() == 0
    assert res.tables["items"].count() == t.items.count()
    counts = {r.table_name: (r.good_rows, r.bad_rows) for r in res.counts.collect()}
    assert counts["items"] == (t.items.count(), 0)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = Build(spark, csv_ingest.market_tables(res), P, persist=False)
        plan = got.lines._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.splitlines() if "FileScan parquet" in x and "hot_items" in x]
        assert any("Bucketed: true" in x for x in scans), scans  # the rest, bucket by bucket
        assert "BroadcastHashJoin [order_id" in plan  # the hot lines, though broadcasts by size are off
        want = Build(spark, t, P, persist=False)
        for j in JOBS:
            assert sorted(map(tuple, getattr(got, j).collect()), key=repr) == sorted(map(tuple, getattr(want, j).collect()), key=repr), j
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_hot_keys_of_a_sketch(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 10 == 1, "b").otherwise(F.concat(F.lit("k"), "id")).alias("k"))
    assert sorted(csv_ingest.hot_keys(df, "k", 64)) == ["a", "b"]
    assert csv_ingest.hot_keys(df, "k", 4) == ["a"]
    assert csv_ingest.hot_keys(df.where("k like 'k%'"), "k", 64) == [] and csv_ingest.hot_keys(df.limit(0), "k", 8) == []
