"""Streaming ingest: files count once, bad rows are quarantined, the rebuild sees all rows."""

import os
import shutil
import tempfile

from deliverix.streaming import start_ingest_stream

HEADER = ("order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n")


def test_ingest_stream_appends_once(spark):
    landing = tempfile.mkdtemp(prefix="deliverix-landing-")
    out = tempfile.mkdtemp(prefix="deliverix-stream-out-")
    ckpt = tempfile.mkdtemp(prefix="deliverix-stream-ckpt-")
    seen = []

    def write(name, body):
        tmp = os.path.join(tempfile.mkdtemp(), name)
        with open(tmp, "w") as f:
            f.write(HEADER + body)
        shutil.move(tmp, os.path.join(landing, name))  # atomic arrival

    write("a.csv", "o1,1,p1,s1,2018-01-03 00:00:00,10.0,1.0\nbad,x,p1,s1,2018-01-03 00:00:00,1.0,1.0\n")
    q = start_ingest_stream(spark, landing, "items", out, ckpt, on_batch=seen.append)
    q.awaitTermination(120)
    write("b.csv", "o2,1,p2,s1,2018-01-04 00:00:00,20.0,2.0\n")
    q = start_ingest_stream(spark, landing, "items", out, ckpt, on_batch=seen.append)
    q.awaitTermination(120)
    q = start_ingest_stream(spark, landing, "items", out, ckpt, on_batch=seen.append)  # nothing new
    q.awaitTermination(120)
    items = spark.read.parquet(f"{out}/items")
    assert sorted(r.order_id for r in items.collect()) == ["o1", "o2"]
    assert spark.read.parquet(f"{out}/_quarantine/items").count() == 1
    assert len(seen) == 2


def test_stream_ingest_then_rebuild(spark):
    from deliverix.plans.build import Build, build_for
    from deliverix.sources import csv_ingest
    from deliverix.sources.schemas import RAW_FILES
    from deliverix.streaming import tables_from_parquet

    b = build_for(spark, "/root/testdata/sf0.001")
    raw = tempfile.mkdtemp(prefix="deliverix-stream-raw-")
    out = tempfile.mkdtemp(prefix="deliverix-stream-tables-")
    ckpt = tempfile.mkdtemp(prefix="deliverix-stream-ckpt2-")
    geo = b.t.regions.selectExpr("region_code AS geolocation_city", "region_code AS geolocation_state")
    paths = csv_ingest.export_raw_csv(b.t, geo, raw)
    for table in RAW_FILES:
        # each exported folder is a landing folder of CSV part files
        start_ingest_stream(spark, paths[table], table, out, ckpt).awaitTermination(300)
    c = Build(spark, tables_from_parquet(spark, out), b.params, persist=False)
    for name in ("otdr", "cohort", "sla_state", "lead_category"):
        assert sorted(map(tuple, getattr(c, name).collect())) == sorted(map(tuple, getattr(b, name).collect())), name


def test_repeated_batch_counts_once(spark):
    from deliverix.sources.csv_ingest import CORRUPT
    from deliverix.streaming.ingest_stream import write_batch
    out = tempfile.mkdtemp(prefix="deliverix-replay-")
    batch = spark.createDataFrame([("o1", 1, None), (None, None, "x,y")], f"order_id string, order_item_id int, {CORRUPT} string")
    write_batch(batch, 0, out, "items")
    write_batch(batch, 0, out, "items")  # the batch again, as after a crash between write and commit
    write_batch(batch, 1, out, "items")
    assert spark.read.parquet(f"{out}/items").count() == 2
    assert spark.read.parquet(f"{out}/_quarantine/items").count() == 2
