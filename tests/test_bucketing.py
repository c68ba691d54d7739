"""Opt-in bucketing by order_id: same results, and when the joins shuffle (as
at scale), the bucketed line table is read by bucket instead of shuffled."""

import re
import tempfile

from deliverix.plans.build import Build, build_for
from deliverix.sources import csv_ingest

SF = "/root/testdata/sf0.001"


def test_bucketed_ingest(spark):
    b = build_for(spark, SF)
    root = tempfile.mkdtemp(prefix="deliverix-bucket-")
    geo = b.t.regions.selectExpr("region_code AS geolocation_city", "region_code AS geolocation_state")
    csv_ingest.export_raw_csv(b.t, geo, f"{root}/raw")
    res = csv_ingest.ingest_csv(spark, f"{root}/raw", f"{root}/tables", order_buckets=8, table_prefix="bk")
    t = csv_ingest.market_tables(res)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    old_adaptive = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        c = Build(spark, t, b.params, persist=False)
        lines = c.lines
        lines.collect()
        plan = lines._jdf.queryExecution().executedPlan().toString()
        scans = [l for l in plan.splitlines() if "FileScan parquet" in l and "bk_items" in l]
        assert scans and all("Bucketed: true" in l for l in scans), scans
        for name in ("otdr", "cohort", "lead_category", "volume"):
            assert sorted(map(tuple, getattr(c, name).collect())) == sorted(map(tuple, getattr(b, name).collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", old_adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
