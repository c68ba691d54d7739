"""Fixed schemas of the raw marketplace CSV exports (no inference pass)."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _s(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


ORDERS = _s(
    ("order_id", StringType()), ("customer_id", StringType()), ("order_status", StringType()),
    ("order_purchase_timestamp", TimestampNTZType()), ("order_approved_at", TimestampNTZType()),
    ("order_delivered_carrier_date", TimestampNTZType()),
    ("order_delivered_customer_date", TimestampNTZType()),
    ("order_estimated_delivery_date", TimestampNTZType()),
)
ITEMS = _s(
    ("order_id", StringType()), ("order_item_id", IntegerType()), ("product_id", StringType()),
    ("seller_id", StringType()), ("shipping_limit_date", TimestampNTZType()),
    ("price", DoubleType()), ("freight_value", DoubleType()),
)
PRODUCTS = _s(
    ("product_id", StringType()), ("product_category_name", StringType()),
    ("product_name_lenght", IntegerType()), ("product_description_lenght", IntegerType()),
    ("product_photos_qty", IntegerType()), ("product_weight_g", DoubleType()),
    ("product_length_cm", DoubleType()), ("product_height_cm", DoubleType()),
    ("product_width_cm", DoubleType()),
)
TRANSLATIONS = _s(("product_category_name", StringType()), ("product_category_name_english", StringType()))
SELLERS = _s(
    ("seller_id", StringType()), ("seller_zip_code_prefix", StringType()),
    ("seller_city", StringType()), ("seller_state", StringType()),
)
CUSTOMERS = _s(
    ("customer_id", StringType()), ("customer_unique_id", StringType()),
    ("customer_zip_code_prefix", StringType()), ("customer_city", StringType()),
    ("customer_state", StringType()),
)
REVIEWS = _s(
    ("review_id", StringType()), ("order_id", StringType()), ("review_score", IntegerType()),
    ("review_comment_title", StringType()), ("review_comment_message", StringType()),
    ("review_creation_date", TimestampNTZType()), ("review_answer_timestamp", TimestampNTZType()),
)
GEO = _s(
    ("geolocation_zip_code_prefix", StringType()), ("geolocation_lat", DoubleType()),
    ("geolocation_lng", DoubleType()), ("geolocation_city", StringType()),
    ("geolocation_state", StringType()),
)

# Default file name of each raw table; callers pass their own mapping when
# the export uses other names (several names per table are accepted).
RAW_FILES = {
    "orders": (("orders.csv",), ORDERS),
    "items": (("order_items.csv", "items.csv"), ITEMS),
    "products": (("products.csv",), PRODUCTS),
    "translations": (("category_translation.csv", "translations.csv"), TRANSLATIONS),
    "sellers": (("sellers.csv",), SELLERS),
    "customers": (("customers.csv",), CUSTOMERS),
    "reviews": (("order_reviews.csv", "reviews.csv"), REVIEWS),
    "geo": (("geolocation.csv", "geo.csv"), GEO),
}
