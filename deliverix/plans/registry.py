"""Job registry: query key -> DataFrame of one build.

Keys follow SURVEY section 2.1 (J01-J53).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deliverix.plans.build import Build, build_for

JOBS: dict[str, Callable[[Build], DataFrame]] = {
    # ingest and quality
    "ingest_raw_tables": lambda b: b.ingest_counts,                 # J01 (row counts of the inputs)
    "ingest_csv_exports": lambda b: b.csv_ingest_roundtrip(),       # J01 (CSV ingest with quarantine)
    "orders_clean": lambda b: b.clean,                              # J02
    "status_distribution": lambda b: b.status_distribution,         # J03
    "review_distribution": lambda b: b.review_distribution,         # J04
    "schema_validation": lambda b: b.validation,                    # J05
    "quality_gates": lambda b: b.gates,                             # J06
    # KPI tables
    "kpi_otdr_monthly": lambda b: b.otdr,                           # J07
    "kpi_lead_time_category": lambda b: b.lead_category,            # J08
    "lead_time_detail": lambda b: b.lead_detail,                    # J09
    "kpi_seller_scorecard": lambda b: b.seller,                     # J10
    "kpi_sla_breach_geo": lambda b: b.sla_geo,                      # J11
    "kpi_sla_breach_state": lambda b: b.sla_state,                  # J12
    "kpi_cohort_retention": lambda b: b.cohort,                     # J13
    "kpi_volume_trend": lambda b: b.volume,                         # J14
    "kpi_product_velocity": lambda b: b.velocity,                   # J15
    "kpi_freight_efficiency": lambda b: b.freight,                  # J16
    # derived analytics
    "freight_corridors": lambda b: b.corridors,                     # J17
    "overall_otdr": lambda b: b.overall,                            # J18
    "otdr_trend": lambda b: b.trend,                                # J19
    "seller_bottom_decile": lambda b: b.bottom,                     # J20
    "state_lead_breach_corr": lambda b: b.state_corr,               # J21
    "state_lead_breach_pvalue": lambda b: b.state_corr_p,           # J21 (p-value)
    "retention_matrix": lambda b: b.retention_matrix,               # J22
    "retention_summary": lambda b: b.retention,                     # J23
    "customer_ltv_proxy": lambda b: b.ltv,                          # J24
    "order_financials": lambda b: b.financials,                     # J25
    "volume_wow_growth": lambda b: b.volume_wow,                    # J26
    "top_gmv_weeks": lambda b: b.top_weeks,                         # J27
    "product_velocity_inventory": lambda b: b.velocity_inventory,   # J28
    "median_freight_cost": lambda b: b.median_freight,              # J29
    "kpi_summary": lambda b: b.kpi_summary,                         # J30 (includes the p-value)
    "kpi_summary_metrics": lambda b: b.metrics,                     # J30 without the p-value
    "export_tables": lambda b: b.export(),                          # J31
    # chart data
    "otdr_rolling_ci": lambda b: b.otdr_ci,                         # J32
    "lead_time_top10_distribution": lambda b: b.lead_top_distribution,  # J33
    "seller_scatter": lambda b: b.seller_scatter,                   # J34
    "state_breach_map_values": lambda b: b.state_map,               # J35
    "freight_outlier_lanes": lambda b: b.outlier_lanes,             # J36
    "velocity_top20": lambda b: b.velocity_top20,                   # J37
    "p90_vs_benchmark": lambda b: b.p90_benchmark,                  # J38
    "seller_score_histogram": lambda b: b.score_histogram,          # J39
    "volume_weekly_combo": lambda b: b.weekly_combo,                # J45
    # write-up figures
    "category_extremes": lambda b: b.category_extremes,             # J40
    "seller_worst5": lambda b: b.seller_worst5,                     # J41
    "state_extremes": lambda b: b.state_extremes,                   # J42
    "corridor_cost_premium": lambda b: b.corridor_premium,          # J43
    "impact_sizing": lambda b: b.impact,                            # J44
    # interactive views
    "view_kpi_cards": lambda b: b.kpi_cards,                        # J46
    "view_filter_domains": lambda b: b.filter_domains,              # J47
    "view_categories": lambda b: b.view_categories(),               # J48
    "view_sellers": lambda b: b.view_sellers(),                     # J49
    "view_states": lambda b: b.view_states(),                       # J50
    "view_corridors": lambda b: b.view_corridors(),                 # J51
    "view_velocity": lambda b: b.view_velocity(),                   # J52
    "consistency_checks": lambda b: b.consistency,                  # J53
}


def run(key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return JOBS[key](build_for(spark, sf_dir))


def query_callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def make(key: str) -> Callable[[SparkSession, str], DataFrame]:
        def q(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(key, spark, sf_dir)
        q.__name__ = key
        return q
    return {key: make(key) for key in JOBS}
