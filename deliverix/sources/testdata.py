"""Adapter: the driver's star-schema parquet -> canonical marketplace tables.

The testdata is TPC-H-like (orders, lineitem, customer, supplier, part,
nation, region).  The mapping below gives every canonical column a value
derived from those tables, so that all branches of the jobs are exercised
(NULL estimates, missing translations, zero freight, several reviews per
order, orders that never arrive).  The same mapping is written in SQL in
:mod:`deliverix.plans.oracle` for the DuckDB cross-check.

Scale notes
-----------
* lineitem is the only fact table read twice (items, first ship date,
  reviews); each read is pruned to the columns it needs.
* The first ship date on or after the order date is found without shipping
  every line to the order's task: lines are pre-aggregated per order into the
  set of distinct ship days (partial aggregation runs map-side, so a
  hot order contributes at most one entry per calendar day), then the set is
  filtered against the order date with a higher-order function.
* nation and region are geography-bounded and broadcast; customer, part and
  supplier grow with the data and are left to Spark's size-checked join
  selection (static threshold + AQE runtime statistics).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from deliverix.functions.columns import round_half_away
from deliverix.sources.tables import MarketTables

# Fixed values of the adapter -------------------------------------------------
# order status letter -> marketplace status
STATUS_BY_CODE = {"F": "delivered", "O": "shipped", "P": "processing"}
# order priority -> promised delivery window in days (no promise for 4-NOT SPECIFIED)
PROMISE_DAYS_BY_PRIORITY = {"1-URGENT": 180, "2-HIGH": 360, "3-MEDIUM": 540, "5-LOW": 720}
# part type treated as "no category"
UNCATEGORISED_TYPE = "LARGE"
# category translations (SMALL has none on purpose)
CATEGORY_TRANSLATIONS = [
    ("STANDARD", "standard"),
    ("ECONOMY", "economy"),
    ("MEDIUM", "medium"),
    ("PROMO", "promo"),
]
REVIEW_RETURN_FLAG = "R"
# ------------------------------------------------------------------------------

TESTDATA_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(col: str, mapping: dict) -> F.Column:
    expr = None
    for key, value in mapping.items():
        expr = (F.when(F.col(col) == F.lit(key), F.lit(value)) if expr is None
                else expr.when(F.col(col) == F.lit(key), F.lit(value)))
    return expr


def translations_frame(spark: SparkSession) -> DataFrame:
    """The translation table as a literal relation (keeps real size statistics,
    unlike a frame created from a Python list, whose size is unknown to the
    planner and would block broadcast decisions downstream)."""
    rows = [F.struct(F.lit(a).alias("product_category_name"), F.lit(b).alias("product_category_name_english"))
            for a, b in CATEGORY_TRANSLATIONS]
    return spark.range(1).select(F.inline(F.array(*rows)))


def load_testdata(spark: SparkSession, sf_dir: str) -> MarketTables:
    t = {name: read_table(spark, sf_dir, name) for name in TESTDATA_TABLES}
    nation = F.broadcast(t["nation"].select("n_nationkey", "n_name", "n_regionkey"))
    region = F.broadcast(t["region"].select("r_regionkey", "r_name"))

    lines = t["lineitem"]
    ship_days = (
        lines.select("l_orderkey", F.col("l_shipdate").cast("timestamp_ntz").alias("l_shipdate"))
        .groupBy("l_orderkey")
        .agg(F.collect_set("l_shipdate").alias("ship_days"))
    )
    o = t["orders"].select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"),
    )
    o = o.join(ship_days.hint("merge"), o.o_orderkey == ship_days.l_orderkey, "left")
    first_ship = F.array_min(F.filter("ship_days", lambda d: d >= F.col("o_orderdate")))
    delivered = first_ship + F.make_dt_interval(hours=F.lit(12))
    purchase = F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    promise = _case("o_orderpriority", PROMISE_DAYS_BY_PRIORITY)
    orders = o.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        _case("o_orderstatus", STATUS_BY_CODE).alias("order_status"),
        purchase.alias("order_purchase_timestamp"),
        (purchase + F.make_dt_interval(hours=F.lit(1))).alias("order_approved_at"),
        (delivered - F.make_dt_interval(days=F.lit(1))).alias("order_delivered_carrier_date"),
        delivered.alias("order_delivered_customer_date"),
        (F.col("o_orderdate") + F.make_dt_interval(days=promise)).alias("order_estimated_delivery_date"),
    )

    customers = (
        t["customer"].select("c_custkey", "c_nationkey", "c_mktsegment")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_custkey").alias("customer_unique_id"),
            F.col("c_mktsegment").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )
    )

    items = lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").alias("price"),
        round_half_away(F.col("l_extendedprice") * F.col("l_tax"), 2).alias("freight_value"),
    )

    side = F.col("p_size").cast("double")
    products = t["part"].select(
        F.col("p_partkey").alias("product_id"),
        F.nullif(F.col("p_type"), F.lit(UNCATEGORISED_TYPE)).alias("product_category_name"),
        (side * F.lit(100.0)).alias("product_weight_g"),
        side.alias("product_length_cm"),
        side.alias("product_height_cm"),
        side.alias("product_width_cm"),
    )

    sellers = (
        t["supplier"].select("s_suppkey", "s_nationkey")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("n_name").alias("seller_city"),
            F.col("r_name").alias("seller_state"),
        )
    )

    reviews = lines.where(F.col("l_returnflag") == F.lit(REVIEW_RETURN_FLAG)).select(
        F.col("l_orderkey").alias("order_id"),
        F.ceil(F.col("l_quantity") / F.lit(10.0)).cast("int").alias("review_score"),
    )

    regions = t["nation"].select(F.col("n_name").alias("region_code"))

    return MarketTables(
        orders=orders, customers=customers, items=items, products=products,
        translations=translations_frame(spark), sellers=sellers, reviews=reviews,
        regions=regions,
        geo=t["nation"].select(F.col("n_name").alias("geolocation_city"), F.col("n_name").alias("geolocation_state")),
    )
