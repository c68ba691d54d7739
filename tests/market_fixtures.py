"""Small hand-made canonical tables for edge-case tests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from deliverix.sources import schemas
from deliverix.sources.tables import MarketTables


def ts(s: str | None) -> dt.datetime | None:
    return None if s is None else dt.datetime.fromisoformat(s)


def _frame(spark: SparkSession, schema, rows: list[dict]):
    names = [f.name for f in schema.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def order(oid: str, cust: str, purchase: str | None, delivered: str | None, estimated: str | None,
          status: str = "delivered") -> dict:
    return {"order_id": oid, "customer_id": cust, "order_status": status,
            "order_purchase_timestamp": ts(purchase), "order_approved_at": ts(purchase),
            "order_delivered_carrier_date": ts(delivered), "order_delivered_customer_date": ts(delivered),
            "order_estimated_delivery_date": ts(estimated)}


def customer(cid: str, unique: str | None = None, state: str = "SP", city: str = "x") -> dict:
    return {"customer_id": cid, "customer_unique_id": unique or cid, "customer_state": state,
            "customer_city": city}


def item(oid: str, n: int, product: str, seller: str, price: float, freight: float) -> dict:
    return {"order_id": oid, "order_item_id": n, "product_id": product, "seller_id": seller,
            "price": price, "freight_value": freight}


def product(pid: str, category: str | None, weight: float = 1000.0, side: float = 10.0) -> dict:
    return {"product_id": pid, "product_category_name": category, "product_weight_g": weight,
            "product_length_cm": side, "product_height_cm": side, "product_width_cm": side}


def tables(spark: SparkSession, orders, customers, items=(), products=(), translations=(),
           sellers=(), reviews=()) -> MarketTables:
    c = _frame(spark, schemas.CUSTOMERS, list(customers))
    return MarketTables(
        orders=_frame(spark, schemas.ORDERS, list(orders)),
        customers=c,
        items=_frame(spark, schemas.ITEMS, list(items)),
        products=_frame(spark, schemas.PRODUCTS, list(products)),
        translations=_frame(spark, schemas.TRANSLATIONS, [
            {"product_category_name": a, "product_category_name_english": b} for a, b in translations]),
        sellers=_frame(spark, schemas.SELLERS, [
            {"seller_id": s, "seller_city": city, "seller_state": st} for s, city, st in sellers]),
        reviews=_frame(spark, schemas.REVIEWS, [
            {"review_id": f"r{i}", "order_id": o, "review_score": sc} for i, (o, sc) in enumerate(reviews)]),
        regions=c.selectExpr("customer_state AS region_code").distinct(),
    )
