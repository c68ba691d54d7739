"""KPI tables J07-J16.

Each function takes the shared base relations and returns an unordered
DataFrame (the reference's ORDER BY inside views is applied only by sinks
and top-k reports).  Aggregations that need several distinct counts are
written as two-level aggregations (first to the order grain, then to the
report grain) so no Expand of the item rows is needed and partial
aggregation stays map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliverix.functions.columns import (
    exact_avg,
    month_diff,
    month_start,
    ratio,
    round_half_away,
    round_stable,
    week_diff,
)
from deliverix.params import DEFAULT, Params

def LATE() -> F.Column:
    return F.col("is_late")


def N() -> F.Column:
    """COUNT(*)."""
    return F.count(F.lit(1))


def _pct(num: F.Column, den: F.Column) -> F.Column:
    return F.lit(100.0) * num.cast("double") / den.cast("double")


def _late_sum() -> F.Column:
    return F.sum(LATE()).cast("bigint")


def otdr_monthly(core: DataFrame) -> DataFrame:
    """On-time delivery rate per purchase month."""
    return core.groupBy("purchase_month").agg(
        N().alias("total_orders"),
        _late_sum().alias("late_orders"),
        (N() - _late_sum()).alias("on_time_orders"),
        round_half_away(_pct(N() - _late_sum(), N()), 2).alias("otdr_pct"),
        round_half_away(F.avg(F.when(LATE() == 1, F.col("delay_days"))), 1).alias("avg_delay_when_late_days"),
        round_stable(F.percentile("actual_lead_time_days", 0.95), 1).alias("p95_lead_time"),
    )


def order_categories(lines_cat: DataFrame) -> DataFrame:
    """Distinct (order, category) pairs with the order's lead time and lateness."""
    return lines_cat.select("order_id", "category_en", "actual_lead_time_days", "is_late").distinct()


def lead_time_category(lines_cat: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Lead-time distribution per category (orders counted once per category)."""
    qs = F.percentile("actual_lead_time_days", [0.5, 0.75, 0.90, 0.99])
    lead = F.col("actual_lead_time_days")
    agg = order_categories(lines_cat).groupBy("category_en").agg(
        N().alias("total_orders"),
        round_half_away(F.avg(lead), 1).alias("avg_lead_time"),
        qs.alias("_q"),
        round_stable(F.stddev_samp(lead), 1).alias("lead_time_std"),
        round_half_away(_pct(_late_sum(), N()), 1).alias("late_rate_pct"),
    )
    return agg.where(F.col("total_orders") >= params.min_category_orders).select(
        "category_en", "total_orders", "avg_lead_time",
        round_stable(F.col("_q")[0], 1).alias("median_lead_time"),
        round_stable(F.col("_q")[1], 1).alias("p75_lead_time"),
        round_stable(F.col("_q")[2], 1).alias("p90_lead_time"),
        round_stable(F.col("_q")[3], 1).alias("p99_lead_time"),
        "lead_time_std", "late_rate_pct",
    )


def lead_time_detail(lines_cat: DataFrame) -> DataFrame:
    """Distinct order, category and lead time (input of the distribution charts)."""
    return (lines_cat.where(F.col("actual_lead_time_days").isNotNull())
            .select("order_id", "category_en", "actual_lead_time_days").distinct())


def seller_scorecard(lines_seller: DataFrame, reviews: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per-seller delivery, revenue and review scorecard (sellers with enough orders)."""
    per_order_review = reviews.groupBy("order_id").agg(F.avg("review_score").alias("review_score"))
    # lines -> seller x order grain first (map-side partial aggregation, so an
    # order with very many lines collapses before any shuffle), then attach the
    # order-level review; every line of an order carries the same review, so
    # this equals averaging it over the lines as the reference does
    seller_order = (
        lines_seller
        .groupBy("seller_id", "seller_state", "seller_city", "order_id", "actual_lead_time_days", "is_late")
        .agg(F.sum(F.col("price").cast("decimal(18,2)")).alias("order_gmv"))
        .join(per_order_review, on="order_id", how="left")
    )
    review = F.avg("review_score")
    bad = F.sum(F.when(F.col("review_score") <= params.bad_review_max, 1).otherwise(0)).cast("bigint")
    late_pct = _pct(_late_sum(), N())
    composite = (F.lit(100.0) - late_pct) * F.lit(0.5) + (
        F.coalesce(review, F.lit(0.0)) / F.lit(5.0) * F.lit(100.0)) * F.lit(0.5)
    out = seller_order.groupBy("seller_id", "seller_state", "seller_city").agg(
        N().alias("total_orders"),
        round_half_away(F.sum("order_gmv").cast("double"), 0).alias("total_gmv"),
        round_half_away(F.avg("actual_lead_time_days"), 1).alias("avg_lead_time"),
        round_half_away(late_pct, 1).alias("late_rate_pct"),
        round_half_away(review, 2).alias("avg_review_score"),
        bad.alias("bad_reviews"),
        round_half_away(_pct(bad, N()), 1).alias("bad_review_rate_pct"),
        round_half_away(composite, 1).alias("seller_composite_score"),
    )
    return out.where(F.col("total_orders") >= params.min_seller_orders)


def sla_breach_geo(core: DataFrame) -> DataFrame:
    """SLA breach per customer state and month."""
    return core.groupBy("customer_state", "purchase_month").agg(
        N().alias("total_orders"),
        _late_sum().alias("late_orders"),
        round_half_away(_pct(_late_sum(), N()), 1).alias("breach_rate_pct"),
        round_half_away(F.avg(F.when(LATE() == 1, F.col("delay_days"))), 1).alias("avg_delay_days"),
        round_half_away(F.avg("actual_lead_time_days"), 1).alias("avg_lead_time"),
    )


def sla_breach_state(core: DataFrame) -> DataFrame:
    """SLA breach per customer state."""
    return core.groupBy("customer_state").agg(
        N().alias("total_orders"),
        _late_sum().alias("late_orders"),
        round_half_away(_pct(_late_sum(), N()), 1).alias("breach_rate_pct"),
        round_half_away(F.avg("actual_lead_time_days"), 1).alias("avg_lead_time"),
        round_half_away(F.avg(F.when(LATE() == 1, F.col("delay_days"))), 1).alias("avg_delay_when_late"),
    )


def customer_months(core: DataFrame) -> DataFrame:
    """One row per customer: cohort month and the set of months with a purchase.

    The set holds at most one entry per calendar month, whatever the number of
    orders, and is built with map-side partial aggregation.
    """
    per = core.groupBy("customer_unique_id").agg(
        F.collect_set(month_start("purchase_ts")).alias("active_months"))
    return per.select("customer_unique_id", F.array_min("active_months").alias("cohort_month"), "active_months")


def cohort_retention(core: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Share of each first-purchase cohort active N() months later (sparse: no zero fill)."""
    per = customer_months(core)
    sizes = per.groupBy("cohort_month").agg(N().alias("cohort_customers"))
    start = F.lit(params.cohort_start).cast("date").cast("timestamp_ntz")
    active = (
        per.where(F.col("cohort_month") >= start)
        .select("cohort_month", F.explode("active_months").alias("activity_month"))
        .select("cohort_month", month_diff("cohort_month", "activity_month").alias("month_number"))
        .where(F.col("month_number") <= params.cohort_max_month)
        .groupBy("cohort_month", "month_number").agg(N().alias("active_customers"))
    )
    # one row per cohort month: bounded by the calendar
    return active.join(F.broadcast(sizes), on="cohort_month", how="inner").select(
        "cohort_month", "month_number", "cohort_customers", "active_customers",
        round_half_away(_pct(F.col("active_customers"), F.col("cohort_customers")), 1).alias("retention_rate_pct"),
    )


def order_grain(lines: DataFrame) -> DataFrame:
    """Per clean order: week, customer and additive sums of its lines."""
    return lines.groupBy("order_id", "purchase_week", "customer_unique_id").agg(
        F.sum(F.col("price").cast("decimal(18,2)")).alias("sum_price"),
        F.count("price").alias("n_price"),
        F.sum(F.col("freight_value").cast("decimal(18,2)")).alias("sum_freight"),
        F.count("freight_value").alias("n_freight"),
        F.sum((F.col("price") + F.col("freight_value")).cast("decimal(18,2)")).alias("order_value"),
        F.sum(ratio("freight_value", "price")).alias("sum_freight_ratio"),
        F.count(ratio("freight_value", "price")).alias("n_freight_ratio"),
    )


def volume_trend(lines: DataFrame) -> DataFrame:
    """Weekly orders, customers, GMV (price + freight) and freight share."""
    return volume_from_orders(order_grain(lines))


def volume_from_orders(g: DataFrame) -> DataFrame:
    """J14 from the order-grain sums."""
    return g.groupBy("purchase_week").agg(
        N().alias("orders"),
        F.count_distinct("customer_unique_id").alias("unique_customers"),
        round_half_away(F.sum("order_value").cast("double"), 0).alias("total_gmv"),
        round_half_away(F.try_divide(F.sum("sum_price").cast("double"), F.sum("n_price").cast("double")), 2)
        .alias("avg_item_price"),
        round_half_away(F.try_divide(F.sum("sum_freight").cast("double"), F.sum("n_freight").cast("double")), 2)
        .alias("avg_freight"),
        round_half_away(F.try_divide(F.sum("sum_freight_ratio"), F.sum("n_freight_ratio").cast("double"))
                        * F.lit(100.0), 1).alias("freight_pct_of_price"),
    )


def product_velocity(lines_cat: DataFrame) -> DataFrame:
    """Units, orders, revenue and units per week of the active span, per category."""
    per_order = lines_cat.groupBy("category_en", "order_id").agg(
        F.count("order_item_id").alias("units"),
        F.sum(F.col("price").cast("decimal(18,2)")).alias("sum_price"),
        F.count("price").alias("n_price"),
        F.min("purchase_ts").alias("first_ts"),
        F.max("purchase_ts").alias("last_ts"),
        F.sum(F.col("product_weight_g").cast("decimal(18,2)")).alias("sum_weight"),
        F.count("product_weight_g").alias("n_weight"),
        F.sum(F.col("volume_m3").cast("decimal(18,6)")).alias("sum_volume"),
        F.count("volume_m3").alias("n_volume"),
    )
    agg = per_order.groupBy("category_en").agg(
        F.sum("units").alias("units_sold"),
        N().alias("orders"),
        F.sum("sum_price").alias("_price"), F.sum("n_price").alias("_n_price"),
        F.min("first_ts").alias("_first"), F.max("last_ts").alias("_last"),
        F.sum("sum_weight").alias("_weight"), F.sum("n_weight").alias("_n_weight"),
        F.sum("sum_volume").alias("_volume"), F.sum("n_volume").alias("_n_volume"),
    )
    weeks = F.nullif(week_diff("_first", "_last"), F.lit(0).cast("bigint"))
    return agg.select(
        "category_en", "units_sold", "orders",
        round_half_away(F.col("_price").cast("double"), 0).alias("total_revenue"),
        round_half_away(F.try_divide(F.col("_price").cast("double"), F.col("_n_price").cast("double")), 2)
        .alias("avg_unit_price"),
        round_half_away(F.col("units_sold").cast("double") / weeks.cast("double"), 1).alias("units_per_week"),
        round_half_away(F.try_divide(F.col("_weight").cast("double"), F.col("_n_weight").cast("double"))
                        / F.lit(1000.0), 2).alias("avg_weight_kg"),
        round_half_away(F.try_divide(F.col("_volume").cast("double"), F.col("_n_volume").cast("double")), 3)
        .alias("avg_volume_m3"),
    )


def freight_efficiency(lines_cat_seller: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Freight cost and reliability per seller state x customer state x category lane."""
    lanes = lines_cat_seller.where(F.col("freight_value") > 0)
    agg = lanes.groupBy("seller_state", "customer_state", "category_en").agg(
        N().alias("shipments"),
        round_half_away(exact_avg("freight_value"), 2).alias("avg_freight_cost"),
        round_half_away(exact_avg("price"), 2).alias("avg_item_value"),
        round_half_away(F.avg(ratio("freight_value", "price")) * F.lit(100.0), 1).alias("freight_pct_of_value"),
        round_half_away(F.avg("actual_lead_time_days"), 1).alias("avg_lead_time"),
        round_half_away(_pct(_late_sum(), N()), 1).alias("late_rate_pct"),
    )
    return agg.where(F.col("shipments") >= params.min_lane_shipments)
