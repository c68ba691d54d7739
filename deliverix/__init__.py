"""Marketplace operations analytics on Spark.

Sub-packages:
    sources    -- readers (CSV with quarantine, testdata adapter) and sinks
    functions  -- Column helpers (rounding, calendar arithmetic, ranks, statistics)
    operators  -- the data jobs: clean base, KPI tables, derived metrics, views, checks
    plans      -- job registry, per-session build cache, DuckDB oracle SQL
    streaming  -- incremental (file-triggered) variant of the KPI build
"""

from deliverix.params import Params

__all__ = ["Params"]
