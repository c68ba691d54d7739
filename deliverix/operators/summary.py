"""The headline metrics as a long (metric, value) table.

All inputs are one-row frames; they are cross-joined into one row and
unpivoted, so the whole summary is a single Spark plan.  Text metrics carry
``value_text``, numeric ones ``value_num``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliverix.functions.joins import cross_one_row

# Metric names and order of the reference's summary table.
METRICS = [
    "overall_otdr_pct", "otdr_min_pct", "otdr_max_pct", "otdr_slope_pct_per_month",
    "otdr_trend_direction", "worst_otdr_month", "worst_otdr_pct", "otdr_reporting_month_threshold",
    "bottom_seller_count", "bottom_seller_breach_share_pct", "bottom_seller_order_share_pct",
    "state_breach_corr", "state_breach_corr_pvalue", "retention_m1_pct", "retention_m3_pct",
    "retention_m6_pct", "retention_m12_pct", "best_m3_cohort", "best_m3_retention_pct",
    "worst_m3_cohort", "worst_m3_retention_pct", "avg_orders_per_customer", "average_order_value",
    "ltv_proxy", "total_orders", "total_gmv", "aov", "median_freight_cost",
]
TEXT_METRICS = {"otdr_trend_direction", "worst_otdr_month", "best_m3_cohort", "worst_m3_cohort"}


def summary_metrics(one_row_frames: list[DataFrame], exclude: tuple[str, ...] = ()) -> DataFrame:
    """Unpivot the metrics found in the one-row frames to (position, metric, value_num, value_text, value);
    ``value`` is the metric as text, as the exported ``metric,value`` table shows it."""
    row = cross_one_row(one_row_frames[0], *one_row_frames[1:])
    cells = []
    for pos, name in enumerate(METRICS, start=1):
        if name in exclude or name not in row.columns:
            continue
        is_text = name in TEXT_METRICS
        cells.append(F.struct(
            F.lit(pos).alias("position"),
            F.lit(name).alias("metric"),
            (F.lit(None).cast("double") if is_text else F.col(name).cast("double")).alias("value_num"),
            (F.col(name).cast("string") if is_text else F.lit(None).cast("string")).alias("value_text"),
        ))
    rows = row.select(F.explode(F.array(*cells)).alias("m")).select("m.*")
    return rows.withColumn("value", F.coalesce("value_text", number_text(F.col("value_num"))))


def number_text(value: F.Column) -> F.Column:
    """A number as plain text with at most 12 decimals; below 1e-6 with its first 12 digits and an exponent.  No zeros at the end."""
    plain = value.cast("decimal(38,12)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(plain, "0+$", ""), "\\.$", "")
    tiny = F.regexp_replace(F.regexp_replace(F.format_string("%.11e", value), "0+e", "e"), "\\.e", "e")
    return F.when(value.isNotNull(), F.when((value != 0) & (F.abs(value) < 1e-6), tiny).otherwise(plain))


def summary_map(summary: DataFrame) -> DataFrame:
    """One row, one map column ``metric -> value`` (text metrics as text, numbers
    rendered as strings), the form the dashboard reads the summary file in."""
    return summary.agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))


def summary_values(summary: DataFrame) -> dict:
    """Edge action: the (at most a few dozen) summary metrics as a Python dict."""
    return {r.metric: (r.value_text if r.value_text is not None else r.value_num) for r in summary.collect()}
