"""Derived analytics J17-J30: metrics computed from the KPI tables.

The reference does this step in pandas on the driver.  Here every metric
stays a DataFrame: inputs are KPI results (bounded by calendar, geography or
catalogue size), windows without PARTITION BY only ever run over such
bounded results, and only scalar rows reach the driver when a caller
collects them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deliverix.functions.columns import exact_avg, round_half_away, round_python
from deliverix.functions.rank import avg_pct_rank, first_by_key
from deliverix.functions.stats import exact_pearson_r, exact_slope, student_t_pvalue
from deliverix.operators.kpis import N, _pct
from deliverix.functions.joins import cross_one_row
from deliverix.params import DEFAULT, Params


def freight_corridors(freight: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Seller state x customer state corridors from the lane table.

    As in the reference, corridor metrics are unweighted means of the rounded
    lane rows, and lanes below the lane threshold are already gone.
    """
    route = freight.groupBy("seller_state", "customer_state").agg(
        F.sum("shipments").cast("bigint").alias("shipments"),
        exact_avg("avg_freight_cost", 2).alias("avg_freight_cost"),
        exact_avg("avg_lead_time", 1).alias("avg_lead_time"),
        exact_avg("late_rate_pct", 1).alias("late_rate_pct"),
        exact_avg("freight_pct_of_value", 1).alias("freight_pct_of_value"),
    ).where(F.col("shipments") >= params.min_corridor_shipments)
    ranked = avg_pct_rank(route, "avg_freight_cost", "_cost_rank")
    route = avg_pct_rank(ranked, "late_rate_pct", "_late_rank", source=route)
    return route.select(
        "seller_state", "customer_state", "shipments", "avg_freight_cost", "avg_lead_time",
        "late_rate_pct", "freight_pct_of_value",
        (F.col("_cost_rank") * F.lit(0.5) + F.col("_late_rank") * F.lit(0.5)).alias("cost_late_index"),
    )


def overall_otdr(core: DataFrame) -> DataFrame:
    """On-time share of all clean orders."""
    return core.agg(
        round_half_away(_pct(F.sum(F.lit(1) - F.col("is_late")), N()), 2).alias("overall_otdr_pct"))


def reporting_months(otdr: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Months with enough orders, numbered 0.. in calendar order (bounded: one row per month)."""
    rep = otdr.where(F.col("total_orders") >= params.min_month_orders)
    return rep.withColumn("month_index", F.row_number().over(Window.orderBy("purchase_month")) - 1)


def otdr_trend(otdr: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Slope per month (position index), range and worst month of the reporting months."""
    rep = reporting_months(otdr, params)
    agg = rep.agg(
        N().alias("reporting_months"),
        exact_slope(F.col("month_index"), F.col("otdr_pct"), 2).alias("otdr_slope_pct_per_month"),
        F.min("otdr_pct").alias("otdr_min_pct"),
        F.max("otdr_pct").alias("otdr_max_pct"),
        # ties: the earliest month wins
        F.min_by("purchase_month", F.struct("otdr_pct", "purchase_month")).alias("_worst"),
    )
    return agg.select(
        "reporting_months", "otdr_slope_pct_per_month", "otdr_min_pct", "otdr_max_pct",
        F.date_format("_worst", "yyyy-MM").alias("worst_otdr_month"),
        F.col("otdr_min_pct").alias("worst_otdr_pct"),
        F.when(F.col("otdr_slope_pct_per_month") > 0, F.lit("improving"))
        .otherwise(F.lit("deteriorating")).alias("otdr_trend_direction"),
        F.lit(params.min_month_orders).cast("bigint").alias("otdr_reporting_month_threshold"),
    )


def bottom_sellers(seller: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The ceil(share * n) (at least 1) lowest-scoring sellers, ties by seller_id.

    Distributed without a global sort: the composite score is rounded to one
    decimal in [0, 100], so a histogram over it has at most 1,001 rows.  The
    cumulative histogram fixes the boundary score; groups below it are taken
    whole, and the sellers sharing the boundary score are cut by id
    (see :func:`first_by_key`).
    """
    score = "seller_composite_score"
    hist = seller.groupBy(score).agg(N().alias("_n"))
    cum = Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select(
        score, "_n",
        F.coalesce(F.sum("_n").over(cum), F.lit(0)).alias("_before"),
        F.greatest(F.lit(1).cast("bigint"),
                   F.ceil(F.sum("_n").over(Window.partitionBy()).cast("double") * F.lit(params.bottom_share))
                   .cast("bigint")).alias("_k"),
    ).where(F.col("_before") < F.col("_k"))
    # groups wholly inside the bottom set are taken without ordering; of the
    # boundary group (at most one score value) only one id range is ordered
    hist = hist.select(score, "_n", F.least(F.col("_n"), F.col("_k") - F.col("_before")).alias("_take"))
    whole = seller.join(F.broadcast(hist.where(F.col("_take") == F.col("_n")).select(score)),
                        on=score, how="left_semi")
    edge = seller.join(F.broadcast(hist.where(F.col("_take") < F.col("_n")).select(score, "_take")),
                       on=score, how="inner")
    edge = first_by_key(edge, "seller_id", F.col("_take")).drop("_take")
    return whole.unionByName(edge)


def seller_bottom_decile(seller: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Share of scorecard late orders and of orders held by the bottom sellers.

    Late orders per seller are rebuilt from the rounded rate (orders x rate),
    as in the reference; sums are exact (rate has one decimal).
    """
    late = (F.col("total_orders").cast("decimal(38,0)") * F.col("late_rate_pct").cast("decimal(18,1)"))
    tot = seller.agg(N().alias("scored_sellers"), F.sum("total_orders").alias("_orders"),
                     F.sum(late).alias("_late"))
    bottom = bottom_sellers(seller, params).agg(
        N().alias("bottom_seller_count"), F.sum("total_orders").alias("_b_orders"), F.sum(late).alias("_b_late"))
    j = cross_one_row(tot, bottom)
    return j.select(
        "scored_sellers", "bottom_seller_count",
        round_python(F.try_divide(F.lit(100.0) * F.col("_b_late").cast("double"), F.col("_late").cast("double")), 1)
        .alias("bottom_seller_breach_share_pct"),
        round_python(F.try_divide(F.lit(100.0) * F.col("_b_orders").cast("double"), F.col("_orders").cast("double")), 1)
        .alias("bottom_seller_order_share_pct"),
    )


def state_lead_breach_corr(sla_state: DataFrame) -> DataFrame:
    """Pearson r of state lead time vs breach rate (exact sums)."""
    return sla_state.agg(
        N().alias("n_states"),
        exact_pearson_r(F.col("avg_lead_time"), F.col("breach_rate_pct"), 1, 1).alias("state_breach_corr"),
    )


def state_lead_breach_pvalue(sla_state: DataFrame) -> DataFrame:
    """J21 with the two-sided p-value (Student t, n-2 dof) on the one-row result."""
    r = state_lead_breach_corr(sla_state)
    return r.withColumn("state_breach_corr_pvalue", student_t_pvalue(F.col("state_breach_corr"), F.col("n_states")))


def retention_matrix(cohort: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Cohort x months-since-first-purchase matrix; absent cells are NULL."""
    months = list(range(params.cohort_max_month + 1))
    wide = cohort.groupBy("cohort_month").pivot("month_number", months).agg(F.max("retention_rate_pct"))
    return wide.select("cohort_month", *[F.col(str(m)).alias(f"m{m}") for m in months])


def retention_summary(cohort: DataFrame) -> DataFrame:
    """Mean retention over present cells at months 1, 3, 6, 12; best/worst month-3 cohort."""
    mn, r = F.col("month_number"), F.col("retention_rate_pct")

    def at(m: int) -> F.Column:
        return round_python(exact_avg(F.when(mn == m, r), 1), 2).alias(f"retention_m{m}_pct")

    m3 = mn == 3
    best = F.min_by("cohort_month", F.when(m3, F.struct((-r).alias("k"), F.col("cohort_month"))))
    worst = F.min_by("cohort_month", F.when(m3, F.struct(r.alias("k"), F.col("cohort_month"))))
    agg = cohort.agg(at(1), at(3), at(6), at(12),
                     best.alias("_best"), F.max(F.when(m3, r)).alias("best_m3_retention_pct"),
                     worst.alias("_worst"), F.min(F.when(m3, r)).alias("worst_m3_retention_pct"))
    return agg.select(
        "retention_m1_pct", "retention_m3_pct", "retention_m6_pct", "retention_m12_pct",
        F.coalesce(F.date_format("_best", "yyyy-MM"), F.lit("NA")).alias("best_m3_cohort"),
        "best_m3_retention_pct",
        F.coalesce(F.date_format("_worst", "yyyy-MM"), F.lit("NA")).alias("worst_m3_cohort"),
        "worst_m3_retention_pct",
    )


def customer_ltv_proxy(order_grain: DataFrame) -> DataFrame:
    """Mean orders per customer x mean order value (price + freight)."""
    per_customer = order_grain.groupBy("customer_unique_id").agg(N().alias("lifetime_orders"))
    a = per_customer.agg((F.sum("lifetime_orders").cast("double") / N().cast("double")).alias("avg_orders_per_customer"))
    b = order_grain.agg(F.try_divide(F.sum("order_value").cast("double"), F.count("order_value").cast("double"))
                        .alias("average_order_value"))
    return cross_one_row(a, b).withColumn(
        "ltv_proxy", F.col("avg_orders_per_customer") * F.col("average_order_value"))


def order_financials(order_grain: DataFrame) -> DataFrame:
    """Clean orders, GMV and average order value (price + freight)."""
    return order_grain.agg(
        N().alias("total_orders"),
        F.sum("order_value").cast("double").alias("total_gmv"),
        F.try_divide(F.sum("order_value").cast("double"), F.count("order_value").cast("double")).alias("aov"),
    )


def volume_wow_growth(volume: DataFrame) -> DataFrame:
    """Weekly volume with week-over-week order growth (previous row; gaps not filled)."""
    prev = F.lag("orders").over(Window.orderBy("purchase_week"))
    growth = (F.try_divide(F.col("orders").cast("double"), prev.cast("double")) - F.lit(1.0)) * F.lit(100.0)
    return volume.withColumn("wow_order_growth_pct", growth)


def top_gmv_weeks(volume: DataFrame, n: int = 3) -> DataFrame:
    """The n highest-GMV weeks, their AOV and what drove them."""
    med = volume.agg(F.percentile("orders", 0.5).alias("_median_orders"))
    top = volume.orderBy(F.desc("total_gmv"), F.asc("purchase_week")).limit(n)
    return cross_one_row(top, med).select(
        "purchase_week", "orders", "total_gmv",
        (F.col("total_gmv") / F.col("orders").cast("double")).alias("aov"),
        F.when(F.col("orders").cast("double") > F.col("_median_orders"), F.lit("High order volume"))
        .otherwise(F.lit("Higher AOV/item mix")).alias("driver"),
    )


def product_velocity_inventory(velocity: DataFrame, lead_category: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Velocity with category lead time and a reorder-point stock-out proxy."""
    lead = lead_category.select("category_en", "avg_lead_time", "p90_lead_time")
    v = velocity.join(lead, on="category_en", how="left")
    upw = F.col("units_per_week")
    monthly = upw * F.lit(params.weeks_per_month)
    demand = upw * F.col("avg_lead_time") / F.lit(7.0)
    return v.select(
        *velocity.columns, "avg_lead_time", "p90_lead_time",
        monthly.alias("monthly_units"),
        demand.alias("lead_time_demand_units"),
        monthly.alias("reorder_point_units"),
        F.coalesce(demand > monthly, F.lit(False)).alias("stockout_risk"),
    )


def median_freight_cost(freight: DataFrame) -> DataFrame:
    """Median lane freight cost (interpolated; rounded to 6 digits against last-bit noise)."""
    return freight.agg(round_half_away(F.percentile("avg_freight_cost", 0.5), 6).alias("median_freight_cost"))
