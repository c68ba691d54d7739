"""Data behind the reference's charts (J32-J39, J45); rendering is not built.

Top-k selections use ``orderBy(...).limit(k)`` with a fixed small k, which
Spark plans as a per-partition top-k followed by a k-row merge; every order
has a key tie-break so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deliverix.functions.columns import round_half_away
from deliverix.functions.rank import avg_pct_rank, dense_code
from deliverix.operators.kpis import N
from deliverix.functions.joins import cross_one_row
from deliverix.params import DEFAULT, Params


def otdr_rolling_ci(otdr: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Monthly OTDR, trailing mean over ``rolling_rows`` months and a 95 % CI."""
    w = Window.orderBy("purchase_month").rowsBetween(-(params.rolling_rows - 1), 0)
    rolling = F.try_divide(F.sum(F.col("otdr_pct").cast("decimal(18,2)")).over(w).cast("double"),
                           F.count("otdr_pct").over(w).cast("double"))
    p = F.col("otdr_pct") / F.lit(100.0)
    ci = F.lit(params.ci_z) * F.sqrt(p * (F.lit(1.0) - p) / F.col("total_orders").cast("double")) * F.lit(100.0)
    return otdr.select(
        "purchase_month", "total_orders", "otdr_pct",
        rolling.alias("otdr_rolling_pct"),
        ci.alias("ci_half_width"),
    ).select("*", (F.col("otdr_pct") - F.col("ci_half_width")).alias("ci_lower"),
             (F.col("otdr_pct") + F.col("ci_half_width")).alias("ci_upper"))


def largest_categories(lead_category: DataFrame, n: int) -> DataFrame:
    return lead_category.orderBy(F.desc("total_orders"), F.asc("category_en")).limit(n)


def lead_time_top_distribution(lead_category: DataFrame, lead_detail: DataFrame, n: int = 10) -> DataFrame:
    """Five-number summary of lead time for the n largest categories, with
    their plotting order (ascending median lead time)."""
    top = largest_categories(lead_category, n).select(
        "category_en",
        F.row_number().over(Window.orderBy("median_lead_time", "category_en")).cast("bigint").alias("plot_order"))
    detail = lead_detail.join(F.broadcast(top), on="category_en", how="inner")
    q = F.percentile("actual_lead_time_days", [0.25, 0.5, 0.75])
    stats = detail.groupBy("category_en", "plot_order").agg(
        N().alias("orders"),
        F.min("actual_lead_time_days").alias("min_lead"),
        q.alias("_q"),
        F.max("actual_lead_time_days").alias("max_lead"),
    )
    return stats.select(
        "category_en", "plot_order", "orders", "min_lead",
        round_half_away(F.col("_q")[0], 6).alias("q1_lead"),
        round_half_away(F.col("_q")[1], 6).alias("median_lead"),
        round_half_away(F.col("_q")[2], 6).alias("q3_lead"),
        "max_lead",
    )


def worst_sellers(seller: DataFrame, n: int) -> DataFrame:
    return seller.orderBy(F.asc("seller_composite_score"), F.asc("seller_id")).limit(n)


def seller_scatter(seller: DataFrame, n_labels: int = 5) -> DataFrame:
    """Seller points (late rate x review), marker size, state code and labels of the worst."""
    pts = dense_code(seller, "seller_state", "state_code")
    labels = worst_sellers(seller, n_labels).select(
        "seller_id", F.substring(F.col("seller_id").cast("string"), 1, 6).alias("label"))
    pts = pts.join(F.broadcast(labels), on="seller_id", how="left")
    return pts.select(
        "seller_id", "seller_state", "late_rate_pct", "avg_review_score", "total_orders",
        F.greatest(F.lit(30).cast("bigint"), F.least(F.lit(500).cast("bigint"), F.col("total_orders")))
        .alias("marker_size"),
        "state_code", "label",
    )


def state_breach_map_values(regions: DataFrame, sla_state: DataFrame) -> DataFrame:
    """Every map region with its breach rate (NULL where no orders)."""
    rates = sla_state.select(F.col("customer_state").alias("region_code"), "breach_rate_pct")
    return regions.select("region_code").distinct().join(rates, on="region_code", how="left")


def freight_outlier_lanes(freight: DataFrame, n: int = 5) -> DataFrame:
    """Every lane (cost x lead time) with marker size; the ``n`` lanes with the
    highest cost rank + late rank carry a label, the others NULL."""
    f = avg_pct_rank(freight, "avg_freight_cost", "_pc")
    f = avg_pct_rank(f, "late_rate_pct", "_pl", source=freight)
    f = f.withColumn("index_score", F.col("_pc") + F.col("_pl"))
    lane = ["seller_state", "customer_state", "category_en"]
    top = f.orderBy(F.desc("index_score"), *lane).limit(n).select(
        *[F.col(c).alias(f"_{c}") for c in lane],
        F.concat(F.col("seller_state"), F.lit("->"), F.col("customer_state")).alias("label"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in lane]
    f = f.join(F.broadcast(top), same[0] & same[1] & same[2], "left")
    return f.select(
        "seller_state", "customer_state", "category_en", "shipments", "avg_freight_cost",
        "avg_lead_time", "late_rate_pct", "index_score",
        F.greatest(F.lit(30).cast("bigint"), F.least(F.lit(400).cast("bigint"), F.col("shipments") * 2))
        .alias("marker_size"),
        "label",
    )


def velocity_top(velocity_inventory: DataFrame, n: int = 20) -> DataFrame:
    """The n fastest-selling categories (units per week), slowest of them first."""
    v = velocity_inventory.where(F.col("category_en").isNotNull())
    return (v.orderBy(F.desc_nulls_last("units_per_week"), F.asc("category_en")).limit(n)
            .select("category_en", "units_per_week")
            .orderBy(F.asc("units_per_week"), F.desc("category_en")))


def p90_vs_benchmark(lead_category: DataFrame, n: int = 20) -> DataFrame:
    """First n categories by P90 lead time, flagged against the median P90 of all categories."""
    bench = lead_category.agg(round_half_away(F.percentile("p90_lead_time", 0.5), 6).alias("category_median_p90"))
    top = lead_category.orderBy(F.desc_nulls_last("p90_lead_time"), F.asc("category_en")).limit(n)
    return cross_one_row(top, bench).select(
        "category_en", "p90_lead_time", "category_median_p90",
        (F.col("p90_lead_time") > F.col("category_median_p90")).alias("above_benchmark"),
    )


def seller_score_histogram(seller: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Equal-width histogram of composite scores and the bottom-share cut-off.

    A score lies in the bin whose published edges hold it (low <= score < high,
    the last bin also its high edge): the computed index can be off by one next
    to an edge and is moved to the bin that fits.
    """
    bins = params.histogram_bins
    score = F.col("seller_composite_score")
    st = seller.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"),
                    round_half_away(F.percentile(score, params.bottom_share), 6).alias("bottom_decile_cutoff"))
    same = F.col("_hi") == F.col("_lo")
    st = st.select(
        F.when(same, F.col("_lo") - F.lit(0.5)).otherwise(F.col("_lo")).alias("_lo"),
        F.when(same, F.col("_hi") + F.lit(0.5)).otherwise(F.col("_hi")).alias("_hi"),
        "bottom_decile_cutoff",
    )
    norm = F.lit(float(bins)) / (F.col("_hi") - F.col("_lo"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    idx = F.least(F.floor((score - F.col("_lo")) * norm).cast("int") + F.lit(1), F.lit(bins))
    low = F.col("_lo") + (F.col("_i") - 1).cast("double") * step
    high = F.col("_lo") + F.col("_i").cast("double") * step
    fit = (F.when(score < low, F.col("_i") - 1)
           .when((score >= high) & (F.col("_i") < bins), F.col("_i") + 1).otherwise(F.col("_i")))
    counts = (cross_one_row(seller.select(score).where(score.isNotNull()), st).withColumn("_i", idx)
              .select(fit.alias("bin")).groupBy("bin").agg(N().alias("sellers")))
    edges = st.select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "_lo", "_hi",
                      "bottom_decile_cutoff")
    edges = edges.select(
        "bin",
        (F.col("_lo") + (F.col("bin") - 1).cast("double") * step).alias("bin_low"),
        F.when(F.col("bin") == bins, F.col("_hi"))
        .otherwise(F.col("_lo") + F.col("bin").cast("double") * step).alias("bin_high"),
        "bottom_decile_cutoff",
    )
    out = edges.join(counts, on="bin", how="left")
    return out.select(
        "bin", "bin_low", "bin_high",
        F.coalesce(F.col("sellers"), F.lit(0).cast("bigint")).alias("sellers"),
        (F.col("bin_low") < F.col("bottom_decile_cutoff")).alias("in_bottom_span"),
        "bottom_decile_cutoff",
    )


def volume_weekly_combo(volume: DataFrame) -> DataFrame:
    """Weekly GMV and order series."""
    return volume.select("purchase_week", "total_gmv", "orders")
