"""Cleaned base relations shared by all KPI jobs.

``orders_clean`` (J02) is the order-grain view of delivered orders.  Most
jobs need only nine of its 22 columns, so :func:`clean_core` is the narrow
projection that the build materializes; :func:`enriched_lines` joins it to
the order lines and to the product and seller dimensions once (the joins
every item-level KPI repeats in the reference) and is materialized as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliverix.functions.columns import day_diff, day_of_week, month_start, week_start
from deliverix.functions.joins import likely_partners
from deliverix.sources.tables import MarketTables

CORE_COLUMNS = (
    "order_id", "customer_unique_id", "customer_state", "purchase_ts",
    "actual_lead_time_days", "delay_days", "is_late", "purchase_month", "purchase_week",
)


def orders_clean(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Delivered orders with a delivery and purchase time, joined to the customer.

    Spark picks the join from measured sizes (adaptive execution).
    """
    o = orders.where(
        (F.col("order_status") == F.lit("delivered"))
        & F.col("order_delivered_customer_date").isNotNull()
        & F.col("order_purchase_timestamp").isNotNull()
    )
    c = customers.select("customer_id", "customer_unique_id", "customer_state", "customer_city")
    j = o.join(c, on="customer_id", how="inner").select(
        "order_id", "customer_id", "customer_unique_id", "customer_state", "customer_city",
        "order_status",
        F.col("order_purchase_timestamp").cast("timestamp_ntz").alias("purchase_ts"),
        F.col("order_approved_at").cast("timestamp_ntz").alias("approved_ts"),
        F.col("order_delivered_carrier_date").cast("timestamp_ntz").alias("carrier_ts"),
        F.col("order_delivered_customer_date").cast("timestamp_ntz").alias("delivered_ts"),
        F.col("order_estimated_delivery_date").cast("timestamp_ntz").alias("estimated_ts"),
    )
    return j.select(
        "order_id", "customer_id", "customer_unique_id", "customer_state", "customer_city",
        "order_status", "purchase_ts", "approved_ts", "carrier_ts", "delivered_ts", "estimated_ts",
        day_diff("purchase_ts", "delivered_ts").alias("actual_lead_time_days"),
        day_diff("purchase_ts", "estimated_ts").alias("promised_lead_time_days"),
        day_diff("delivered_ts", "estimated_ts").alias("days_early_late"),
        # GREATEST skips NULL: no estimate -> 0 days of delay
        F.greatest(day_diff("estimated_ts", "delivered_ts"), F.lit(0).cast("bigint")).alias("delay_days"),
        # timestamps are compared, not days: arriving at 15:00 on the promised
        # day is late although delay_days is 0
        F.when(F.col("delivered_ts") > F.col("estimated_ts"), F.lit(1)).otherwise(F.lit(0)).alias("is_late"),
        F.when(F.col("delivered_ts").isNull(), F.lit(1)).otherwise(F.lit(0)).alias("is_undelivered"),
        month_start("purchase_ts").alias("purchase_month"),
        week_start("purchase_ts").alias("purchase_week"),
        F.year("purchase_ts").cast("bigint").alias("purchase_year"),
        F.month("purchase_ts").cast("bigint").alias("purchase_month_num"),
        day_of_week("purchase_ts").alias("day_of_week"),
    )


def clean_core(clean: DataFrame) -> DataFrame:
    """The nine columns of ``orders_clean`` read downstream."""
    return clean.select(*CORE_COLUMNS)


def product_categories(products: DataFrame, translations: DataFrame) -> DataFrame:
    """product_id -> English category (raw name, then 'Unknown', as fallbacks) and size."""
    t = translations.select("product_category_name", "product_category_name_english")
    p = products.join(t, on="product_category_name", how="left")
    volume = (F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm")) / F.lit(1000000.0)
    return p.select(
        "product_id",
        F.coalesce("product_category_name_english", "product_category_name", F.lit("Unknown")).alias("category_en"),
        F.col("product_weight_g").cast("double").alias("product_weight_g"),
        volume.alias("volume_m3"),
    )


def order_lines(items: DataFrame, core: DataFrame) -> DataFrame:
    """Order lines of clean orders with the order attributes the KPIs use."""
    i = items.select("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value")
    c = core.select("order_id", "customer_unique_id", "customer_state", "purchase_ts",
                    "purchase_week", "actual_lead_time_days", "is_late")
    return i.join(c, on="order_id", how="inner")


def all_order_lines(tables: MarketTables, core: DataFrame, core_bits: DataFrame | None = None) -> DataFrame:
    """:func:`order_lines` of all items.

    ``core_bits``, :func:`key_bits` of the clean orders, leaves out lines of other
    orders before the join shuffles them.  It shuffles whatever the clean orders'
    compressed files let Spark estimate: a broadcast would hold every one of them.
    Lines of hot orders, if the ingest set them apart, meet their few orders by
    broadcast (there are fewer hot orders than buckets), so that no bucket waits for them.
    """
    if tables.hot_items is None:
        items = tables.items
        if core_bits is not None and items.schema["order_id"].dataType == core.schema["order_id"].dataType:
            items = likely_partners(items, "order_id", core_bits)
        return order_lines(items, core.hint("merge"))
    keys = tables.hot_items.select("order_id").distinct()
    hot_core = F.broadcast(core.join(F.broadcast(keys), on="order_id", how="left_semi"))
    return order_lines(tables.bucketed_items, core).unionByName(order_lines(tables.hot_items, hot_core))


def enriched_lines(lines: DataFrame, categories: DataFrame, sellers: DataFrame) -> DataFrame:
    """Order lines of clean orders with order, product and seller attributes, joined once.

    Products and sellers are left-joined on their keys and flagged, so jobs
    that inner-join them in the reference filter on ``has_product`` /
    ``has_seller`` instead of joining again: the line table is shuffled for
    these dimensions once, not once per KPI.  Equivalent to the inner joins
    as long as product_id and seller_id are keys (checked by the quality gates).
    Products meet the lines by a shuffle: a static estimate from the bytes of
    compressed files would broadcast a catalogue many times its size.  Sellers
    are joined as Spark decides (adaptive execution).
    """
    cat = categories.withColumn("has_product", F.lit(True))
    sel = sellers.select("seller_id", "seller_state", "seller_city").withColumn("has_seller", F.lit(True))
    lines = lines.join(cat.hint("merge"), on="product_id", how="left").join(sel, on="seller_id", how="left")
    return lines.select(
        "order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value",
        "customer_state", "purchase_ts", "actual_lead_time_days", "is_late",
        F.coalesce("has_product", F.lit(False)).alias("has_product"),
        "category_en", "product_weight_g", "volume_m3",
        F.coalesce("has_seller", F.lit(False)).alias("has_seller"),
        "seller_state", "seller_city",
    )


def with_product(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("has_product"))


def with_seller(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("has_seller"))
