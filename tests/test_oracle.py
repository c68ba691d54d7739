"""Every job against its DuckDB statement on the sf0.01 testdata (the driver's gate)."""

import pytest

import __spark_entry__ as e
from oracle_harness import run_all

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def results(spark):
    return run_all(spark, SF, sorted(e.oracle_sql()), verbose=False)


def test_all_jobs_match_oracle(results):
    bad = {k: v for k, v in results.items() if not v.get("exact")}
    assert not bad, bad


def test_no_dtype_differences(results):
    diffs = {k: v["dtype_diff"] for k, v in results.items() if v.get("dtype_diff")}
    assert not diffs, diffs
