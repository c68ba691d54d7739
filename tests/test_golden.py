"""The derived jobs give the published results from the published tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import golden_values as G
from deliverix.operators import derived, quality, writeup
from deliverix.operators.summary import number_text
from deliverix.params import Params

#: Thresholds of the published run.
P = Params(min_month_orders=100, min_clean_rows=90_000)


@pytest.fixture(scope="module")
def otdr(spark):
    rows = [(dt.datetime.fromisoformat(m), n, late, pct) for m, n, late, pct in G.OTDR]
    return spark.createDataFrame(rows, "purchase_month timestamp_ntz, total_orders long, late_orders long, otdr_pct double")


@pytest.fixture(scope="module")
def states(spark):
    return spark.createDataFrame(G.STATES, "customer_state string, total_orders long, late_orders long, breach_rate_pct double, avg_lead_time double")


@pytest.fixture(scope="module")
def cohort(spark):
    rows = [(dt.datetime.fromisoformat(m), n, c, r) for m, n, c, r in G.COHORT]
    return spark.createDataFrame(rows, "cohort_month timestamp_ntz, month_number long, cohort_customers long, retention_rate_pct double")


def published(row, names):
    for name in names:
        assert row[name] == pytest.approx(G.SUMMARY[name], rel=1e-12) if isinstance(G.SUMMARY[name], (int, float)) else row[name] == G.SUMMARY[name], name


def test_trend(otdr):
    published(derived.otdr_trend(otdr, P).first(), [
        "otdr_slope_pct_per_month", "otdr_min_pct", "otdr_max_pct", "worst_otdr_month", "worst_otdr_pct",
        "otdr_trend_direction", "otdr_reporting_month_threshold"])


def test_totals_agree_with_the_monthly_table(otdr):
    total = sum(n for _, n, _, _ in G.OTDR)
    assert total == G.SUMMARY["total_orders"]
    late = sum(x for _, _, x, _ in G.OTDR)
    assert round(100 * (total - late) / total, 2) == G.SUMMARY["overall_otdr_pct"]
    core = otdr.select(F.explode(F.sequence(F.lit(1), F.col("total_orders"))).alias("k"), "late_orders").select(
        (F.col("k") <= F.col("late_orders")).cast("int").alias("is_late"))
    assert derived.overall_otdr(core).first().overall_otdr_pct == G.SUMMARY["overall_otdr_pct"]


def test_state_correlation_and_p_value(states):
    row = derived.state_lead_breach_pvalue(states).first()
    assert row.n_states == 27
    published(row, ["state_breach_corr"])
    assert row.state_breach_corr_pvalue == pytest.approx(G.SUMMARY["state_breach_corr_pvalue"], rel=1e-11)
    text = derived.state_lead_breach_pvalue(states).select(number_text(F.col("state_breach_corr_pvalue")).alias("t")).first().t
    assert text == f"{G.SUMMARY['state_breach_corr_pvalue']:.12f}".rstrip("0")


def test_retention(cohort):
    row = derived.retention_summary(cohort).first()
    published(row, ["retention_m1_pct", "retention_m3_pct", "retention_m6_pct", "retention_m12_pct",
                    "best_m3_cohort", "best_m3_retention_pct", "worst_m3_cohort", "worst_m3_retention_pct"])
    wide = {r.cohort_month.strftime("%Y-%m"): r for r in derived.retention_matrix(cohort, P).collect()}
    for month, number, _, rate in G.COHORT:
        assert wide[month[:7]][f"m{number}"] == rate


def test_weekly_growth(spark):
    rows = [(dt.datetime.fromisoformat(w), n, v) for w, n, v, _ in G.VOLUME]
    volume = spark.createDataFrame(rows, "purchase_week timestamp_ntz, orders long, total_gmv double")
    got = {r.purchase_week: r.wow_order_growth_pct for r in derived.volume_wow_growth(volume).collect()}
    for w, _, _, growth in G.VOLUME[1:]:
        assert got[dt.datetime.fromisoformat(w)] == pytest.approx(growth, rel=1e-12)
    top = derived.top_gmv_weeks(volume, 1).first()
    assert top.purchase_week == dt.datetime(2017, 11, 20) and top.driver == "High order volume"


def _corridors(spark, rows):
    lanes = [(s, c, 1000, cost, 0.0, late, 0.0) for s, c, cost, late in rows]
    lanes = spark.createDataFrame(lanes, "seller_state string, customer_state string, shipments long, avg_freight_cost double, "
                                         "avg_lead_time double, late_rate_pct double, freight_pct_of_value double")
    return derived.freight_corridors(lanes, P)


def test_corridor_index(spark):
    """The index is one of ranks, so places stand for the published means (lanes, of few decimals, are not published)."""
    costs, lates = (sorted({r[k] for r in G.CORRIDORS}) for k in (2, 3))
    rows = [(s, c, costs.index(cost) / 100, lates.index(late) / 10) for s, c, cost, late, _ in G.CORRIDORS]
    got = {(r.seller_state, r.customer_state): r.cost_late_index for r in _corridors(spark, rows).collect()}
    assert len(got) == len(G.CORRIDORS)
    for s, c, _, _, index in G.CORRIDORS:
        assert got[s, c] == pytest.approx(index, rel=1e-12), (s, c)


def test_corridor_premium(spark):
    median = spark.createDataFrame([(G.SUMMARY["median_freight_cost"],)], "median_freight_cost double")
    first = writeup.corridor_cost_premium(_corridors(spark, [r[:4] for r in G.CORRIDORS]), median).orderBy("corridor_rank").first()
    assert (first.seller_state, first.customer_state) == G.CORRIDORS[0][:2] and round(first.cost_premium_pct) == 98


def test_inventory_proxy(spark):
    velocity = spark.createDataFrame([r[:2] for r in G.VELOCITY], "category_en string, units_per_week double")
    lead = spark.createDataFrame([(r[0], *r[2:4]) for r in G.VELOCITY if r[2] is not None], "category_en string, avg_lead_time double, p90_lead_time double")
    got = {r.category_en: r for r in derived.product_velocity_inventory(velocity, lead, P).collect()}
    for name, _, lead_days, _, monthly, demand, risk in G.VELOCITY:
        r = got[name]
        assert r.monthly_units == r.reorder_point_units == pytest.approx(monthly, rel=1e-12)
        assert (r.lead_time_demand_units is None) == (demand is None) and r.avg_lead_time == lead_days and r.stockout_risk == risk
        assert demand is None or r.lead_time_demand_units == pytest.approx(demand, rel=1e-12)


def test_impact(spark, states, cohort):
    one = lambda **row: spark.createDataFrame([tuple(row.values())], list(row))
    s = G.SUMMARY
    row = writeup.impact_sizing(
        one(orders_clean_rows=s["total_orders"]), one(overall_otdr_pct=s["overall_otdr_pct"]),
        one(bottom_seller_breach_share_pct=s["bottom_seller_breach_share_pct"]), one(total_gmv=s["total_gmv"], aov=s["aov"]),
        states, cohort, one(avg_orders_per_customer=s["avg_orders_per_customer"]), P).first()
    # The published write-up.
    assert (row.bottom_seller_reducible_late, round(row.seller_revenue_at_risk)) == (333, 2_621_127)
    assert (row.worst_state, round(row.state_revenue_at_risk), row.state_reducible_late) == ("AL", 63_451, 19)
    assert row.incremental_orders == 481


def test_gates_of_the_published_run(spark, otdr, states, cohort):
    full = cohort.withColumn("active_customers", F.when(F.col("month_number") == 0, F.col("cohort_customers")).otherwise(F.lit(0)))
    metrics = spark.createDataFrame([(k, float(v)) for k, v in G.SUMMARY.items() if isinstance(v, (int, float))], "metric string, value_num double")
    bottom = spark.createDataFrame([(G.SUMMARY["bottom_seller_breach_share_pct"], G.SUMMARY["bottom_seller_order_share_pct"])],
                                   "bottom_seller_breach_share_pct double, bottom_seller_order_share_pct double")
    core = spark.createDataFrame([(G.SUMMARY["total_orders"],)], "rows long")
    gates = quality.quality_gates(lambda: core, _Tables(), lambda: metrics, lambda: full, lambda: bottom, lambda: states, lambda: otdr, P)
    names = [g for g in gates if g not in quality.STRUCTURAL_GATES]
    rows = quality.chosen_gates(gates, names).collect()
    assert len(rows) == 11 and all(r.passed for r in rows), [r for r in rows if not r.passed]


class _Tables:
    """Raw tables are not published; the gates on them are left out."""

    orders = customers = translations = products = sellers = None
