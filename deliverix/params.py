"""Job parameters.

The reference hard-codes these numbers; here they are arguments with the
values chosen for the driver's testdata (the dataset is smaller and its
calendar starts earlier than the original one).
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Thresholds of the reference, testdata-sized where noted.
    min_category_orders: int = 200
    min_seller_orders: int = 30
    min_lane_shipments: int = 20
    min_corridor_shipments: int = 100
    min_month_orders: int = 30  # reference: 100
    cohort_start: str = "1995-02-01"  # reference: 2017-01-01
    cohort_max_month: int = 12
    bad_review_max: int = 2
    bottom_share: float = 0.10
    weeks_per_month: float = 4.345
    ci_z: float = 1.96
    min_clean_rows: int = 3000  # reference: 90,000
    rolling_rows: int = 3
    histogram_bins: int = 30
    seller_late_cut: float = 0.25
    state_late_cut: float = 0.20
    retention_lift: float = 0.005
    min_breach_share: float = 15.0
    top_categories: int = 10


DEFAULT = Params()
