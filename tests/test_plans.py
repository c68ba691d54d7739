"""Plan shape guards over every registered job (physical plans, not results)."""

import re

import pytest

from deliverix.plans.build import Build, build_for
from deliverix.plans.registry import query_callables

SF = "/root/testdata/sf0.01"
LINEITEM_COLUMNS = 11


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for key, q in query_callables().items():
        if key in ("export_tables", "ingest_csv_exports"):   # sinks: they write when called
            continue
        df = q(spark, SF)
        out[key] = df._jdf.queryExecution().executedPlan().toString()
    return out


def test_no_cartesian_products(plans):
    bad = [k for k, p in plans.items() if "CartesianProduct" in p]
    assert not bad, bad


def test_no_python_evaluation(plans):
    bad = [k for k, p in plans.items() if re.search(r"ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas", p)]
    assert not bad, bad


def test_lineitem_scans_are_pruned(plans):
    for key, p in plans.items():
        for m in re.finditer(r"FileScan parquet \[([^\]]*)\][^\n]*lineitem\.parquet", p):
            assert len(m.group(1).split(",")) < LINEITEM_COLUMNS, (key, m.group(1))


def test_ship_days_are_combined_before_the_shuffle(spark):
    from deliverix.sources.testdata import load_testdata
    p = load_testdata(spark, SF).orders._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_set" in p
    assert re.search(r"FileScan parquet \[l_orderkey#\d+L,l_shipdate#\d+\]", p)


def test_order_grain_shuffles_items_once(spark):
    b = build_for(spark, SF)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        c = Build(spark, b.t, b.params, persist=False)
        plan = c.order_grain._jdf.queryExecution().sparkPlan().toString()
        full = c.order_grain._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    # one exchange of the lines by order; the sums use its partitioning
    above_join = full[:full.index("SortMergeJoin [order_id")]
    assert "Exchange" not in above_join, full
    assert "part.parquet" not in plan and "supplier.parquet" not in plan


def test_facts_are_tables_that_prune(spark):
    b = build_for(spark, SF)
    plan = b.lines.where("freight_value > 5").select("order_id")._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and "PushedFilters: [IsNotNull(freight_value), GreaterThan(freight_value" in plan
