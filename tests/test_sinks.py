"""J31 round trip: exported CSVs read back with their schema give the same rows."""

import tempfile

from deliverix.plans.build import build_for
from deliverix.sources.sinks import read_exported


def test_export_round_trip(spark):
    b = build_for(spark, "/root/testdata/sf0.01")
    out = tempfile.mkdtemp(prefix="deliverix-export-")
    manifest = {r.table_name: r.rows for r in b.export(out).collect()}
    frames = b.export_frames()
    assert set(manifest) == set(frames) | {"schema_validation"}
    for name in ("otdr", "seller", "cohort", "velocity", "corridors"):
        src = frames[name]
        back = read_exported(spark, out, name, src.schema)
        assert manifest[name] == src.count()
        assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, src.collect()), key=repr), name
    report = [r.value for r in spark.read.text(f"{out}/schema_validation").collect()]
    assert report[3] == f"orders_clean rows: {b.core.count():,}" and report[5].endswith("% of original orders")
    statuses = sorted(b.status_distribution.collect(), key=lambda r: (-r.cnt, r.order_status))
    scores = sorted(b.review_distribution.collect(), key=lambda r: r.review_score)
    assert report[6:8] == ["", "Order status distribution:"]
    assert [line.split() for line in report[8:9 + len(statuses)]] == [["order_status", "cnt", "pct"]] + [
        [r.order_status, str(r.cnt), f"{r.pct:.2f}"] for r in statuses]
    assert len({len(line) for line in report[8:9 + len(statuses)]}) == 1
    rest = report[9 + len(statuses):]
    assert rest[:2] == ["", "Review score distribution:"]
    assert [line.split() for line in rest[2:]] == [["review_score", "cnt"]] + [[str(r.review_score), str(r.cnt)] for r in scores]
    summary = spark.read.option("header", True).csv(f"{out}/kpi_summary")
    assert summary.columns == ["metric", "value"]
    shown = {r.metric: r.value for r in summary.collect()}
    for r in b.kpi_summary.collect():
        assert shown[r.metric] == r.value_text if r.value_text else abs(float(shown[r.metric]) - r.value_num) <= 1e-12 * max(1, abs(r.value_num))


def test_clean_table_partition_pruning(spark):
    from pyspark.sql import functions as F
    b = build_for(spark, "/root/testdata/sf0.01")
    out = tempfile.mkdtemp(prefix="deliverix-clean-")
    t = b.write_clean(out)
    assert t.count() == b.clean.count()
    month = b.otdr.agg(F.max("purchase_month")).first()[0]
    q = t.where(F.col("purchase_month") == F.lit(month))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(purchase_month" in plan
    assert q.count() == b.otdr.where(F.col("purchase_month") == F.lit(month)).first().total_orders
