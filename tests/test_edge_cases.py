"""Hand-made edge cases of the clean base and the KPI jobs (one fixture per branch)."""

import pytest
from pyspark.sql import functions as F

from deliverix.operators.charts import seller_score_histogram
from deliverix.params import Params
from deliverix.plans.build import Build
from market_fixtures import customer, item, order, product, tables

P = Params(min_category_orders=1, min_seller_orders=1, min_lane_shipments=1, min_corridor_shipments=1,
           min_month_orders=1, cohort_start="2017-01-01")


@pytest.fixture(scope="module")
def build(spark):
    orders = [
        order("late_same_day", "c1", "2018-01-01 10:00:00", "2018-01-10 15:00:00", "2018-01-10 00:00:00"),
        order("on_time", "c2", "2018-01-02 08:00:00", "2018-01-10 00:00:00", "2018-01-10 00:00:00"),
        order("null_est", "c3", "2018-01-03 08:00:00", "2018-01-05 09:00:00", None),
        order("shipped", "c4", "2018-01-03 08:00:00", "2018-01-05 09:00:00", "2018-01-09 00:00:00", "shipped"),
        order("no_delivery", "c4", "2018-01-03 08:00:00", None, "2018-01-09 00:00:00"),
        order("no_purchase", "c4", None, "2018-01-05 09:00:00", "2018-01-09 00:00:00"),
        order("midnight", "c5", "2018-02-01 23:00:00", "2018-02-02 01:00:00", "2018-02-20 00:00:00"),
        order("sunday", "c6", "2024-01-07 12:00:00", "2024-01-09 12:00:00", "2024-01-20 00:00:00"),
        order("multi", "c7", "2018-03-05 10:00:00", "2018-03-09 10:00:00", "2018-03-20 00:00:00"),
        order("multi_seller", "c8", "2018-03-06 10:00:00", "2018-03-12 10:00:00", "2018-03-10 00:00:00"),
        order("solo1", "c9", "2018-04-02 10:00:00", "2018-04-04 10:00:00", "2018-04-20 00:00:00"),
        order("solo2", "c9", "2018-04-06 10:00:00", "2018-04-08 10:00:00", "2018-04-20 00:00:00"),
        order("zero_price", "c10", "2018-05-02 10:00:00", "2018-05-04 10:00:00", "2018-05-20 00:00:00"),
    ]
    customers = [customer(f"c{i}", state="SP" if i % 2 else "RJ") for i in range(1, 11)]
    items = [
        item("late_same_day", 1, "p_raw", "s1", 100.0, 10.0),
        item("on_time", 1, "p_null", "s1", 50.0, 5.0),
        item("multi", 1, "p_tr", "s1", 10.0, 1.0),
        item("multi", 2, "p_tr", "s1", 10.0, 1.0),
        item("multi", 3, "p_tr", "s1", 10.0, 1.0),
        item("multi_seller", 1, "p_tr", "s1", 20.0, 2.0),
        item("multi_seller", 2, "p_tr", "s2", 30.0, 0.0),
        item("solo1", 1, "p_solo", "s3", 5.0, 1.0),
        item("solo2", 1, "p_solo", "s3", 5.0, 1.0),
        item("zero_price", 1, "p_tr", "s3", 0.0, 5.0),
        item("zero_price", 2, "p_tr", "s3", 10.0, 1.0),
    ]
    products = [product("p_tr", "cama"), product("p_raw", "raw_cat"), product("p_null", None),
                product("p_solo", "solo")]
    t = tables(spark, orders, customers, items, products, translations=[("cama", "bed"), ("solo", "solo_en")],
               sellers=[("s1", "x", "SP"), ("s2", "y", "MG"), ("s3", "z", "SP")],
               reviews=[("multi", 1), ("multi", 4), ("late_same_day", 2)])
    return Build(spark, t, P, persist=False)


def _by(df, key):
    return {r[key]: r for r in df.collect()}


def test_clean_order_flags(build):
    oc = _by(build.clean, "order_id")
    assert set(oc) == {"late_same_day", "on_time", "null_est", "midnight", "sunday", "multi", "multi_seller",
                       "solo1", "solo2", "zero_price"}
    r = oc["late_same_day"]
    assert (r.is_late, r.delay_days, r.days_early_late) == (1, 0, 0)
    assert oc["on_time"].is_late == 0
    r = oc["null_est"]
    assert (r.is_late, r.delay_days, r.promised_lead_time_days, r.days_early_late) == (0, 0, None, None)
    assert oc["midnight"].actual_lead_time_days == 1
    r = oc["sunday"]
    assert str(r.purchase_week) == "2024-01-01 00:00:00" and r.day_of_week == 0
    assert all(r.is_undelivered == 0 for r in oc.values())
    assert len(build.clean.columns) == 22


def test_category_fallback_and_multi_item(build):
    lead = _by(build.lead_category, "category_en")
    assert set(lead) == {"bed", "raw_cat", "Unknown", "solo_en"}
    assert lead["bed"].total_orders == 3          # multi counted once, multi_seller, zero_price
    assert lead["raw_cat"].lead_time_std is None  # one order -> sample std is NULL
    vel = _by(build.velocity, "category_en")
    assert vel["bed"].units_sold == 3 + 2 + 2
    assert vel["solo_en"].units_per_week is None  # both orders in the same week


def test_seller_scorecard_branches(build):
    s = _by(build.seller, "seller_id")
    assert s["s1"].total_orders == 4 and s["s2"].total_orders == 1   # multi_seller counted for both
    # reviews 1 and 4 on 'multi' average to 2.5 (not bad); 'late_same_day' has a 2 (bad)
    assert s["s1"].bad_reviews == 1
    assert s["s3"].avg_review_score is None
    assert s["s3"].seller_composite_score == round(0.5 * (100 - s["s3"].late_rate_pct), 1)


def test_freight_lanes_skip_zero_freight_and_zero_price(build):
    lanes = build.freight.collect()
    assert not any(r.seller_state == "MG" for r in lanes)   # s2's only line has freight 0
    sp_bed = [r for r in lanes if r.seller_state == "SP" and r.category_en == "bed"]
    # zero_price line (price 0, freight 5) is a shipment but not part of the ratio mean
    vol = _by(build.volume, "purchase_week")
    assert sum(r.shipments for r in sp_bed) == 6
    assert all(r.freight_pct_of_value is not None for r in sp_bed)
    assert all(v.freight_pct_of_price is not None for v in vol.values())


@pytest.fixture(scope="module")
def cohort_build(spark):
    orders = [
        order("a0", "A", "2018-01-15 10:00:00", "2018-01-20 10:00:00", None),
        order("a2", "A", "2018-03-10 10:00:00", "2018-03-15 10:00:00", None),
        order("b0", "B", "2018-01-20 10:00:00", "2018-01-25 10:00:00", None),
        order("b13", "B", "2019-02-05 10:00:00", "2019-02-09 10:00:00", None),
        order("c0", "C", "2016-05-05 10:00:00", "2016-05-09 10:00:00", None),
        order("c1", "C", "2018-01-05 10:00:00", "2018-01-09 10:00:00", None),
        order("d0", "D", "2018-05-05 10:00:00", "2018-05-09 10:00:00", None),
        order("d3", "D", "2018-08-05 10:00:00", "2018-08-09 10:00:00", None),
        order("e0", "E", "2018-06-05 10:00:00", "2018-06-09 10:00:00", None),
        order("e3", "E", "2018-09-05 10:00:00", "2018-09-09 10:00:00", None),
    ]
    t = tables(spark, orders, [customer(c) for c in "ABCDE"])
    return Build(spark, t, P, persist=False)


def test_cohort_sparse_and_bounds(cohort_build):
    rows = {(str(r.cohort_month)[:7], r.month_number): r for r in cohort_build.cohort.collect()}
    assert ("2018-01", 0) in rows and ("2018-01", 2) in rows
    assert ("2018-01", 1) not in rows            # sparse: no zero fill
    assert ("2018-01", 13) not in rows           # beyond max month
    assert rows[("2018-01", 0)].cohort_customers == 2
    assert not any(k[0] == "2016-05" for k in rows)   # before the cohort start


def test_retention_summary_ties(cohort_build):
    r = cohort_build.retention.first()
    assert r.best_m3_cohort == "2018-05" and r.worst_m3_cohort == "2018-05"
    assert r.best_m3_retention_pct == 100.0
    m = cohort_build.retention_matrix.where(F.col("cohort_month") == F.lit("2018-01-01").cast("timestamp_ntz")).first()
    assert m.m0 == 100.0 and m.m1 is None and m.m2 == 50.0


def test_histogram_maximum_in_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in (10, 20, 30, 40)], "seller_composite_score double")
    h = {r.bin: r for r in seller_score_histogram(df, P).collect()}
    assert len(h) == 30 and h[30].sellers == 1 and h[1].sellers == 1
    assert sum(r.sellers for r in h.values()) == 4
    assert h[30].bin_high == 40.0


def test_checkpoint_mode_gives_same_results(spark):
    from deliverix.sources.testdata import load_testdata
    t = load_testdata(spark, "/root/testdata/sf0.001")
    a = Build(spark, t, materialize="checkpoint")
    b = Build(spark, t, materialize="none")
    for name in ("otdr", "seller", "cohort", "freight"):
        assert sorted(getattr(a, name).collect()) == sorted(getattr(b, name).collect())


def test_views_and_summary_map(spark):
    from deliverix.operators.summary import summary_map, summary_values
    from deliverix.plans.build import build_for
    b = build_for(spark, "/root/testdata/sf0.01")
    names = b.register_views()
    assert "kpi_otdr_monthly" in names
    n = spark.sql("SELECT sum(total_orders) AS n FROM kpi_otdr_monthly").first().n
    assert n == spark.sql("SELECT count(*) AS n FROM orders_clean").first().n
    m = summary_map(b.kpi_summary).first().metrics
    vals = summary_values(b.kpi_summary)
    assert len(m) == 28 and float(m["total_orders"]) == vals["total_orders"] == n


def test_gate_raises_below_minimum(spark):
    from deliverix.sources.testdata import load_testdata
    t = load_testdata(spark, "/root/testdata/sf0.001")
    Build(spark, t, Params(min_clean_rows=10), persist=False).check_gates(["orders_clean_min_rows"])
    with pytest.raises(RuntimeError, match="orders_clean_min_rows"):
        Build(spark, t, Params(min_clean_rows=10**9), persist=False).check_gates(["orders_clean_min_rows"])


def test_duplicated_keys_stop_the_export(spark):
    import os
    import tempfile
    rows = dict(
        orders=[order("o1", "c1", "2018-01-01 10:00:00", "2018-01-05 10:00:00", "2018-01-09 00:00:00")],
        customers=[customer("c1")], items=[item("o1", 1, "p1", "s1", 10.0, 1.0)],
        products=[product("p1", "a")], sellers=[("s1", "x", "SP")], translations=[("a", "A")])
    for table in ("orders", "customers", "products", "sellers", "translations"):
        t = tables(spark, **(rows | {table: rows[table] * 2}))
        b = Build(spark, t, Params(min_clean_rows=1), persist=False)
        out = tempfile.mkdtemp(prefix="deliverix-dup-")
        with pytest.raises(RuntimeError, match=f"{table}_unique"):
            b.export(out)
        assert os.listdir(out) == []
        if table in ("products", "sellers"):
            assert b.financials.first().total_gmv == 11.0


def test_missing_metrics_are_named(spark):
    from deliverix.operators.quality import chosen_gates, quality_gates
    summary = spark.createDataFrame([("total_orders", 5.0), ("total_gmv", 1.0)], "metric string, value_num double")
    t = tables(spark, [], [])
    gates = quality_gates(None, t, lambda: summary, None, None, None, None, Params())
    r = chosen_gates(gates, ["required_metrics_present"]).first()
    assert not r.passed and r.observed == 2.0
    assert r.detail == "overall_otdr_pct,bottom_seller_breach_share_pct,retention_m1_pct,retention_m3_pct"
    with pytest.raises(ValueError):
        chosen_gates(gates, ["no_such_gate"])
