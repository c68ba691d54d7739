"""Column helpers shared by the jobs (all JVM-side expressions)."""

from deliverix.functions.columns import (
    day_diff,
    day_of_week,
    exact_avg,
    exact_sum,
    month_diff,
    month_start,
    ratio,
    round_half_away,
    round_stable,
    week_diff,
    week_start,
)
from deliverix.functions.rank import avg_pct_rank, dense_code
from deliverix.functions.stats import exact_pearson_r, exact_slope, pearson_p, student_t_pvalue

__all__ = [
    "avg_pct_rank", "day_diff", "day_of_week", "dense_code", "exact_avg", "exact_pearson_r",
    "exact_slope", "exact_sum", "month_diff", "month_start", "pearson_p", "ratio",
    "round_half_away", "round_stable", "student_t_pvalue", "week_diff", "week_start",
]
