"""Row order of the views and charts that show their rows sorted; unknown gate names; the shared folder."""

import pytest

from deliverix.operators.quality import raise_on_failed_gates
from deliverix.plans.build import build_for
from deliverix.session import ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"


def test_sorted_views(spark):
    b = build_for(spark, SF)
    p90 = [r.p90_lead_time for r in b.view_categories().collect()]
    assert p90 == sorted(p90, reverse=True)
    breach = [r.breach_rate_pct for r in b.view_states().collect()]
    assert breach == sorted(breach, reverse=True)
    units = [r.units_per_week for r in b.velocity_top20.collect()]
    assert units == sorted(units)


def test_unknown_gate_is_an_error(spark):
    gates = spark.createDataFrame([("a", 1.0, 0.0, True)], "expectation string, observed double, threshold double, passed boolean")
    raise_on_failed_gates(gates, ["a"])
    with pytest.raises(ValueError):
        raise_on_failed_gates(gates, ["b"])


class _Cluster:
    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_cluster_without_shared_folder_is_an_error():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Cluster())


def test_outlier_lanes_keep_every_lane(spark):
    b = build_for(spark, "/root/testdata/sf0.01")
    lanes = b.outlier_lanes.collect()
    assert len(lanes) == b.freight.count() > 5
    assert sum(r.label is not None for r in lanes) == 5
    lowest = min(r.index_score for r in lanes if r.label is not None)
    assert all(r.index_score <= lowest for r in lanes if r.label is None)
