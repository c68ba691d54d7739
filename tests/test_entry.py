"""Driver contract: entry smoke, query/oracle key coverage."""

import __spark_entry__ as e

from deliverix.plans.registry import query_callables


def test_entry_runs(spark):
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["purchase_month", "total_orders", "late_orders", "on_time_orders", "otdr_pct",
                          "avg_delay_when_late_days", "p95_lead_time"]


def test_every_job_has_an_oracle():
    q, o = set(e.queries()), set(e.oracle_sql())
    assert o <= q
    jobs = set(query_callables())
    assert jobs <= o
    assert len(jobs) >= 53


def test_pvalue_job(spark):
    r = e.queries()["state_lead_breach_pvalue"](spark, "/root/testdata/sf0.01").first()
    assert 0.0 <= r.state_breach_corr_pvalue <= 1.0
    s = {x.metric: x for x in e.queries()["kpi_summary"](spark, "/root/testdata/sf0.01").collect()}
    assert len(s) == 28 and s["state_breach_corr_pvalue"].value_num == r.state_breach_corr_pvalue
