"""CSV ingest: fixed schemas, quarantine of bad rows, quoted line breaks, completeness."""

import os
import tempfile

import pytest

from deliverix.sources.csv_ingest import ingest_csv, market_tables
from deliverix.sources.schemas import RAW_FILES


def _write(d, name, text):
    with open(os.path.join(d, name), "w", encoding="utf-8") as f:
        f.write(text)


def test_ingest_quarantine_and_multiline(spark):
    d = tempfile.mkdtemp(prefix="deliverix-csv-")
    out = tempfile.mkdtemp(prefix="deliverix-out-")
    _write(d, "orders.csv",
           "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
           "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
           "o1,c1,delivered,2018-01-01 10:00:00,2018-01-01 11:00:00,2018-01-02 10:00:00,"
           "2018-01-05 10:00:00,2018-01-10 00:00:00\n")
    _write(d, "order_items.csv",
           "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
           "o1,1,p1,s1,2018-01-03 00:00:00,10.5,1.2\n"
           "bad,z,p1,s1,2018-01-02 10:00:00,1.0,1.0\n")
    _write(d, "products.csv",
           "product_id,product_category_name,product_name_lenght,product_description_lenght,"
           "product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm\n"
           "p1,cama,10,100,1,500,10,10,10\n")
    _write(d, "category_translation.csv", "product_category_name,product_category_name_english\ncama,bed\n")
    _write(d, "sellers.csv", "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01000,sp,SP\n")
    _write(d, "customers.csv",
           "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
           "c1,u1,01000,sp,SP\n")
    _write(d, "order_reviews.csv",
           "review_id,order_id,review_score,review_comment_title,review_comment_message,"
           "review_creation_date,review_answer_timestamp\n"
           'r1,o1,4,,"good\nsecond line",2018-01-06 00:00:00,2018-01-07 00:00:00\n')
    _write(d, "geolocation.csv",
           "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state\n"
           "01000,-23.5,-46.6,sp,SP\n")
    res = ingest_csv(spark, d, out)
    counts = {r.table_name: (r.good_rows, r.bad_rows) for r in res.counts.collect()}
    assert counts["items"] == (1, 1)
    assert counts["reviews"] == (1, 0)
    assert res.tables["items"].count() == 1
    assert spark.read.parquet(f"{out}/_quarantine/items").count() == 1
    t = market_tables(res)
    assert t.reviews.first().review_score == 4


def test_missing_inputs_are_reported(spark):
    d = tempfile.mkdtemp(prefix="deliverix-empty-")
    with pytest.raises(FileNotFoundError) as e:
        ingest_csv(spark, d, tempfile.mkdtemp())
    assert all(t in str(e.value) for t in RAW_FILES)
