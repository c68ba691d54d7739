"""Figures quoted in the reference's write-up (J40-J44); the prose is not built."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deliverix.functions.joins import cross_one_row
from deliverix.params import DEFAULT, Params


def _extremes(df: DataFrame, value: str, key: str, cols: list[str], n: int) -> DataFrame:
    """First n and last n rows of ``value`` descending (ties by key ascending)."""
    top = df.orderBy(F.desc_nulls_last(value), F.asc(key)).limit(n).select(F.lit("top").alias("extreme"), *cols)
    bottom = (df.orderBy(F.asc_nulls_first(value), F.desc(key)).limit(n)
              .select(F.lit("bottom").alias("extreme"), *cols))
    return top.unionByName(bottom)


def category_extremes(lead_category: DataFrame, n: int = 5) -> DataFrame:
    """Top and bottom categories by P90 lead time, and the count with std/mean > 0.5."""
    cols = ["category_en", "total_orders", "p90_lead_time", "late_rate_pct"]
    ext = _extremes(lead_category, "p90_lead_time", "category_en", cols, n)
    cv = F.try_divide(F.col("lead_time_std"), F.col("avg_lead_time"))
    high = lead_category.agg(F.count_if(cv > F.lit(0.5)).alias("high_variability_categories"))
    return cross_one_row(ext, high)


def seller_worst(seller: DataFrame, n: int = 5) -> DataFrame:
    """The n lowest composite scores."""
    return (seller.orderBy(F.asc("seller_composite_score"), F.asc("seller_id")).limit(n)
            .select("seller_id", "seller_state", "total_orders", "late_rate_pct", "avg_review_score",
                    "seller_composite_score"))


def state_extremes(sla_state: DataFrame, n: int = 5) -> DataFrame:
    """Top and bottom states by breach rate."""
    cols = ["customer_state", "total_orders", "breach_rate_pct", "avg_lead_time", "avg_delay_when_late"]
    return _extremes(sla_state, "breach_rate_pct", "customer_state", cols, n)


def corridor_cost_premium(corridors: DataFrame, median_freight: DataFrame, n: int = 5) -> DataFrame:
    """Worst corridors by cost-late index, with freight premium over the median lane."""
    top = corridors.orderBy(F.desc("cost_late_index"), "seller_state", "customer_state").limit(n)
    top = top.withColumn("corridor_rank", F.row_number().over(
        Window.orderBy(F.desc("cost_late_index"), "seller_state", "customer_state")).cast("bigint"))
    premium = (F.try_divide(F.col("avg_freight_cost"), F.col("median_freight_cost")) - F.lit(1.0)) * F.lit(100.0)
    return cross_one_row(top, median_freight).select(
        "corridor_rank", "seller_state", "customer_state", "shipments", "avg_freight_cost",
        "late_rate_pct", "avg_lead_time", premium.alias("cost_premium_pct"),
    )


def impact_sizing(clean_rows: DataFrame, overall: DataFrame, bottom: DataFrame, financials: DataFrame,
                  sla_state: DataFrame, cohort: DataFrame, ltv: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Opportunity sizing; integer results use half-even rounding like the reference."""
    worst = sla_state.orderBy(F.desc("breach_rate_pct"), F.asc("customer_state")).limit(1).select(
        F.col("customer_state").alias("worst_state"),
        F.col("total_orders").alias("_ws_orders"), F.col("late_orders").alias("_ws_late"))
    eligible = cohort.where(F.col("month_number") == 0).agg(
        F.coalesce(F.sum("cohort_customers"), F.lit(0)).cast("bigint").alias("eligible_cohort_customers"))
    row = cross_one_row(clean_rows, overall, bottom.select("bottom_seller_breach_share_pct"),
                        financials.select("total_gmv", "aov"), worst, eligible,
                        ltv.select("avg_orders_per_customer"))
    share = F.col("bottom_seller_breach_share_pct")
    total_late = F.bround(F.col("orders_clean_rows").cast("double")
                          * (F.lit(100.0) - F.col("overall_otdr_pct")) / F.lit(100.0), 0).cast("bigint")
    row = row.withColumn("total_late_orders", total_late)
    return row.select(
        "total_late_orders",
        F.bround(F.col("total_late_orders").cast("double") * share / F.lit(100.0) * F.lit(params.seller_late_cut), 0)
        .cast("bigint").alias("bottom_seller_reducible_late"),
        (F.col("total_gmv") * share / F.lit(100.0)).alias("seller_revenue_at_risk"),
        "worst_state",
        (F.col("aov") * F.col("_ws_orders").cast("double")).alias("state_revenue_at_risk"),
        F.bround(F.col("_ws_late").cast("double") * F.lit(params.state_late_cut), 0).cast("bigint")
        .alias("state_reducible_late"),
        "eligible_cohort_customers",
        F.bround(F.col("eligible_cohort_customers").cast("double") * F.lit(params.retention_lift)
                 * F.col("avg_orders_per_customer"), 0).cast("bigint").alias("incremental_orders"),
    )
