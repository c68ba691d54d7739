"""Interactive views (J46-J52) as parameterized DataFrame functions.

The reference serves these through a dashboard with widgets; here each view
is a function of the KPI frames and the widget values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliverix.operators.charts import largest_categories
from deliverix.params import DEFAULT, Params

# The metrics shown by each panel of the reference dashboard/notebook.
CARD_METRICS = ["total_orders", "overall_otdr_pct", "worst_otdr_month", "worst_otdr_pct",
                "bottom_seller_breach_share_pct", "retention_m3_pct"]
SNAPSHOT_METRICS = ["overall_otdr_pct", "worst_otdr_month", "worst_otdr_pct",
                    "bottom_seller_breach_share_pct", "retention_m1_pct", "retention_m3_pct", "aov"]
QUALITY_CHECKS = ["null_order_ids", "items_without_order", "orders_clean_rows", "orders_clean_retention_pct"]


def kpi_cards(metrics: DataFrame, validation: DataFrame) -> DataFrame:
    """Headline cards, notebook snapshot and quality table as (panel, name, value_num, value_text)."""
    def panel(name: str, df: DataFrame, key: str, keys: list[str]) -> DataFrame:
        return df.where(F.col(key).isin(keys)).select(
            F.lit(name).alias("panel"), F.col(key).alias("name"), "value_num", "value_text")
    return reduce(lambda a, b: a.unionByName(b), [
        panel("card", metrics, "metric", CARD_METRICS),
        panel("snapshot", metrics, "metric", SNAPSHOT_METRICS),
        panel("quality", validation, "check", QUALITY_CHECKS),
    ])


def filter_domains(seller: DataFrame, sla_state: DataFrame, lead_category: DataFrame,
                   params: Params = DEFAULT) -> DataFrame:
    """Widget domains as (domain, value_text, value_num)."""
    mx = seller.agg(F.max("total_orders").cast("double").alias("value_num")).select(
        F.lit("max_seller_orders").alias("domain"), F.lit(None).cast("string").alias("value_text"), "value_num")
    states = sla_state.select("customer_state").distinct().select(
        F.lit("customer_state").alias("domain"), F.col("customer_state").alias("value_text"),
        F.lit(None).cast("double").alias("value_num"))
    cats = lead_category.where(F.col("category_en").isNotNull()).select("category_en").distinct().select(
        F.lit("category").alias("domain"), F.col("category_en").alias("value_text"),
        F.lit(None).cast("double").alias("value_num"))
    default = largest_categories(lead_category, params.top_categories).select(
        F.lit("default_category").alias("domain"), F.col("category_en").alias("value_text"),
        F.col("total_orders").cast("double").alias("value_num"))
    return mx.unionByName(states).unionByName(cats).unionByName(default)


def view_categories(lead_category: DataFrame, categories: Sequence[str] | None = None,
                    params: Params = DEFAULT) -> DataFrame:
    """Selected categories (default: the largest ones), five columns, longest P90 first."""
    if categories is None:
        chosen = lead_category.join(
            F.broadcast(largest_categories(lead_category, params.top_categories).select("category_en")),
            on="category_en", how="left_semi")
    else:
        chosen = lead_category.where(F.col("category_en").isin(list(categories)))
    return (chosen.select("category_en", "total_orders", "avg_lead_time", "p90_lead_time", "late_rate_pct")
            .orderBy(F.desc_nulls_last("p90_lead_time"), F.asc("category_en")))


def view_sellers(seller: DataFrame, min_orders: int | None = None, n: int = 20,
                 params: Params = DEFAULT) -> DataFrame:
    """Worst n sellers by composite score among those with at least ``min_orders``."""
    floor = params.min_seller_orders if min_orders is None else min_orders
    return (seller.where(F.col("total_orders") >= floor)
            .orderBy(F.asc("seller_composite_score"), F.asc("seller_id")).limit(n)
            .select("seller_id", "seller_state", "total_orders", "late_rate_pct", "avg_review_score",
                    "seller_composite_score"))


def view_states(sla_state: DataFrame, states: Sequence[str] | None = None) -> DataFrame:
    """Selected states (default: all), five columns, highest breach rate first."""
    s = sla_state if states is None else sla_state.where(F.col("customer_state").isin(list(states)))
    return (s.select("customer_state", "total_orders", "breach_rate_pct", "avg_lead_time", "avg_delay_when_late")
            .orderBy(F.desc_nulls_last("breach_rate_pct"), F.asc("customer_state")))


def view_corridors(corridors: DataFrame, n: int = 20) -> DataFrame:
    """First n corridors by cost-late index."""
    return (corridors.orderBy(F.desc("cost_late_index"), "seller_state", "customer_state").limit(n)
            .select("seller_state", "customer_state", "shipments", "avg_freight_cost", "late_rate_pct",
                    "avg_lead_time"))


def view_velocity(velocity_inventory: DataFrame, n: int = 30) -> DataFrame:
    """First n categories by units per week."""
    return (velocity_inventory.orderBy(F.desc_nulls_last("units_per_week"), F.asc("category_en")).limit(n)
            .select("category_en", "units_sold", "units_per_week", "avg_lead_time", "stockout_risk"))
