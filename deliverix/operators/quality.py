"""Ingest checks, schema validation, quality gates and consistency checks
(J01, J03-J06, J53).

Every check is an aggregate over the tables it inspects; results are long
frames of (name, observed ...) rows, so they can be written or filtered like
any other result.  :func:`raise_on_failed_gates` is the edge action that
stops a pipeline, as the reference's in-build gate does.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deliverix.functions.columns import round_half_away, round_python
from deliverix.operators.kpis import N
from deliverix.functions.joins import cross_one_row
from deliverix.params import DEFAULT, Params
from deliverix.sources.tables import MarketTables


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _unpivot(row: DataFrame, cells: list[list[F.Column]]) -> DataFrame:
    """One-row frame -> one output row per cell list (a single pass over ``row``)."""
    return row.select(F.explode(F.array(*[F.struct(*c) for c in cells])).alias("_c")).select("_c.*")


#: Keys of the canonical tables: the joins rely on them being unique.
KEYS = {"orders": "order_id", "customers": "customer_id", "translations": "product_category_name",
        "products": "product_id", "sellers": "seller_id"}
STRUCTURAL_GATES = [f"{table}_unique" for table in KEYS]
# Metrics that the reference's validator asks for.
REQUIRED_METRICS = ["overall_otdr_pct", "bottom_seller_breach_share_pct", "retention_m1_pct",
                    "retention_m3_pct", "total_orders", "total_gmv"]


def fact_metrics(name: str) -> list[F.Column]:
    """Named metrics of a table of facts, observed while it is written: rows, null keys, first and last time, late orders."""
    if name == "orders":
        time, more = "order_purchase_timestamp", F.count_if(F.col("order_id").isNull()).alias("null_ids")
    elif name == "core":
        time, more = "purchase_ts", F.sum("is_late").cast("bigint").alias("late")
    else:
        raise ValueError(f"no metrics are defined for {name!r}")
    return [N().alias("rows"), F.min(time).alias("first"), F.max(time).alias("last"), more]


def ingest_row_counts(t: MarketTables) -> DataFrame:
    """J01 (testdata form): row count per canonical table."""
    return _union([df.agg(N().alias("rows")).select(F.lit(name).alias("table_name"), "rows")
                   for name, df in t.as_dict().items()])


def status_distribution(orders: DataFrame) -> DataFrame:
    """Orders per status and share of all orders (window over a handful of statuses)."""
    g = orders.groupBy("order_status").agg(N().alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy())
    return g.select("order_status", "cnt",
                    round_half_away(F.lit(100.0) * F.col("cnt").cast("double") / total.cast("double"), 2).alias("pct"))


def review_distribution(reviews: DataFrame) -> DataFrame:
    """Reviews per score."""
    return reviews.groupBy("review_score").agg(N().alias("cnt"))


def _num(name: str, value: F.Column) -> list:
    return [F.lit(name).alias("check"), value.cast("double").alias("value_num"),
            F.lit(None).cast("string").alias("value_text")]


def _txt(name: str, value: F.Column) -> list:
    return [F.lit(name).alias("check"), F.lit(None).cast("double").alias("value_num"),
            value.cast("string").alias("value_text")]


def _ts(col: str) -> F.Column:
    return F.date_format(F.col(col), "yyyy-MM-dd HH:mm:ss")


def schema_validation(t: MarketTables, orders: DataFrame, core: DataFrame) -> DataFrame:
    """The reference's validation report as (check, value_num, value_text) rows.

    ``orders`` and ``core`` are the one-row metrics of these tables (:func:`fact_metrics`)."""
    o = orders.select("null_ids", F.col("first").alias("dmin"), F.col("last").alias("dmax"), F.col("rows").alias("orig_rows"))
    orphans = t.items.join(t.orders.select("order_id"), on="order_id", how="left_anti").agg(N().alias("orphans"))
    c = core.select(F.col("rows").alias("clean_rows"), F.col("first").alias("cmin"), F.col("last").alias("cmax"))
    row = cross_one_row(o, orphans, c)
    retained = round_python(F.try_divide(F.lit(100.0) * F.col("clean_rows").cast("double"),
                                            F.col("orig_rows").cast("double")), 2)
    parts = [
        _num("null_order_ids", F.col("null_ids")),
        _txt("date_coverage_min", _ts("dmin")),
        _txt("date_coverage_max", _ts("dmax")),
        _num("items_without_order", F.col("orphans")),
        _num("orders_clean_rows", F.col("clean_rows")),
        _txt("orders_clean_date_min", _ts("cmin")),
        _txt("orders_clean_date_max", _ts("cmax")),
        _num("orders_clean_retention_pct", retained),
    ]
    return _unpivot(row, parts)


def quality_gates(core: Callable[[], DataFrame], t: MarketTables, summary_metrics: Callable[[], DataFrame],
                  cohort: Callable[[], DataFrame], bottom: Callable[[], DataFrame],
                  sla_state: Callable[[], DataFrame], otdr: Callable[[], DataFrame],
                  params: Params = DEFAULT) -> dict[str, Callable[[], DataFrame]]:
    """pass/fail expectations of the build, tests and validator of the reference.

    Returns name -> function giving the gate's one row (expectation, observed,
    threshold, passed, detail); ``detail`` names what is missing.  The inputs
    are functions too, so a gate plans and reads only what it needs; the
    structural gates read nothing but the key column of one raw table, and
    ``core`` gives the one-row metrics that were observed while the clean
    orders were written.
    Thresholds are parameters.
    """
    minrows = float(params.min_clean_rows)

    def row(name: str, df: DataFrame, observed: F.Column, threshold: F.Column | float, passed: F.Column,
            detail: F.Column | None = None) -> DataFrame:
        thr = threshold if isinstance(threshold, F.Column) else F.lit(threshold)
        return df.select(F.lit(name).alias("expectation"), observed.cast("double").alias("observed"),
                         thr.cast("double").alias("threshold"), F.coalesce(passed, F.lit(False)).alias("passed"),
                         (F.lit(None) if detail is None else detail).cast("string").alias("detail"))

    def metric(name: str) -> F.Column:
        return F.max(F.when(F.col("metric") == name, F.col("value_num")))

    def at_least(name: str, df: DataFrame, value: F.Column, least: float) -> DataFrame:
        return row(name, df.agg(value.alias("v")), F.col("v"), least, F.col("v") >= least)

    def none_of(name: str, df: DataFrame, bad: F.Column) -> DataFrame:
        return row(name, df.agg(bad.alias("v")), F.col("v"), 0.0, F.col("v") == 0)

    def required(name: str) -> DataFrame:
        wanted = F.array(*[F.lit(m) for m in REQUIRED_METRICS])
        df = summary_metrics().where(F.col("metric").isin(REQUIRED_METRICS)).agg(
            F.array_except(wanted, F.collect_set("metric")).alias("missing"))
        present = F.lit(len(REQUIRED_METRICS)) - F.size("missing")
        return row(name, df, present, float(len(REQUIRED_METRICS)), F.size("missing") == 0,
                   F.nullif(F.array_join("missing", ","), F.lit("")))

    def orders_equal(name: str) -> DataFrame:
        df = cross_one_row(summary_metrics().agg(metric("total_orders").alias("s")),
                           otdr().agg(F.sum("total_orders").alias("o")))
        return row(name, df, F.col("s"), F.col("o"), F.col("s") == F.col("o").cast("double"))

    def otdr_equal(name: str) -> DataFrame:
        expected = round_half_away(F.lit(100.0) * (F.col("o") - F.col("late")).cast("double") / F.col("o").cast("double"), 2)
        df = cross_one_row(summary_metrics().agg(metric("overall_otdr_pct").alias("s")),
                           otdr().agg(F.sum("total_orders").alias("o"), F.sum("late_orders").alias("late")))
        return row(name, df, F.col("s"), expected, F.col("s") == expected)

    def month0(name: str) -> DataFrame:
        bad = (F.col("retention_rate_pct") != 100.0) | (F.col("active_customers") != F.col("cohort_customers"))
        df = cohort().where(F.col("month_number") == 0).agg(N().alias("n"), F.count_if(bad).alias("v"))
        return row(name, df, F.col("v"), 0.0, (F.col("v") == 0) & (F.col("n") > 0))

    share, orders_share = F.col("bottom_seller_breach_share_pct"), F.col("bottom_seller_order_share_pct")

    def states_unique(name: str) -> DataFrame:
        df = sla_state().agg(N().alias("n"), F.count_distinct("customer_state").alias("d"))
        return row(name, df, F.col("d"), F.col("n"), F.col("d") == F.col("n"))

    def unique(name: str, table: DataFrame, key: str) -> DataFrame:
        return none_of(name, table.groupBy(key).agg(N().alias("_c")), F.count_if(F.col("_c") > 1))

    gates: dict[str, Callable[[str], DataFrame]] = {
        "orders_clean_min_rows": lambda n: row(n, core(), F.col("rows"), minrows, F.col("rows") >= minrows),
        "required_metrics_present": required,
        "summary_total_orders_min": lambda n: at_least(n, summary_metrics(), metric("total_orders"), minrows),
        "summary_total_orders_equals_otdr": orders_equal,
        "summary_otdr_equals_otdr_table": otdr_equal,
        "cohort_month0_full_retention": month0,
        "bottom_breach_share_above_order_share": lambda n: row(n, bottom(), share, orders_share, share > orders_share),
        "bottom_breach_share_min": lambda n: row(n, bottom(), share, params.min_breach_share,
                                                 share >= params.min_breach_share),
        "state_rows_unique": states_unique,
        "state_breach_rate_in_0_100": lambda n: none_of(n, sla_state(), F.count_if(~F.col("breach_rate_pct").between(0, 100))),
        "state_orders_min": lambda n: at_least(n, sla_state(), F.sum("total_orders"), minrows),
    }
    for table, key in KEYS.items():
        gates[f"{table}_unique"] = lambda n, df=getattr(t, table), key=key: unique(n, df, key)
    return {name: (lambda name=name, make=make: make(name)) for name, make in gates.items()}


def chosen_gates(gates: dict[str, Callable[[], DataFrame]], names: list[str] | None = None) -> DataFrame:
    """One row per gate (or per named gate); a name that is no gate is an error."""
    unknown = sorted(set(names or ()) - set(gates))
    if unknown:
        raise ValueError(f"no such quality gate: {', '.join(unknown)}")
    return _union([gates[name]() for name in (gates if names is None else names)])


def raise_on_failed_gates(gates: DataFrame, names: list[str] | None = None) -> None:
    """Edge action: raise if any (or any named) gate failed.  Collects at most one row per gate.

    A name that is no gate is an error, not a gate that passes.
    """
    if names is not None:
        unknown = set(names) - {r.expectation for r in gates.select("expectation").collect()}
        if unknown:
            raise ValueError(f"no such quality gate: {', '.join(sorted(unknown))}")
    g = gates if names is None else gates.where(F.col("expectation").isin(names))
    failed = g.where(~F.col("passed")).select("expectation", "observed", "threshold").collect()
    if failed:
        raise RuntimeError("Quality gate failed: " + "; ".join(
            f"{r.expectation} observed={r.observed} threshold={r.threshold}" for r in failed))


def consistency_checks(core: DataFrame, otdr: DataFrame, sla_geo: DataFrame, sla_state: DataFrame) -> DataFrame:
    """State x month breach rows add up to the state rows and to the monthly rows,
    and all three add up to the clean orders, whose one-row metrics are ``core``.  Rows: (check, mismatches, passed)."""
    geo_state = sla_geo.groupBy("customer_state").agg(
        F.sum("total_orders").alias("g_orders"), F.sum("late_orders").alias("g_late"))
    st = sla_state.select("customer_state", F.col("total_orders").alias("s_orders"),
                          F.col("late_orders").alias("s_late"))
    bad_state = (geo_state.join(st, on="customer_state", how="full")
                 .where(~F.col("g_orders").eqNullSafe(F.col("s_orders")) | ~F.col("g_late").eqNullSafe(F.col("s_late")))
                 .agg(N().alias("mismatches")))
    geo_month = sla_geo.groupBy("purchase_month").agg(
        F.sum("total_orders").alias("g_orders"), F.sum("late_orders").alias("g_late"))
    mo = otdr.select("purchase_month", F.col("total_orders").alias("m_orders"),
                     F.col("late_orders").alias("m_late"))
    bad_month = (geo_month.join(mo, on="purchase_month", how="full")
                 .where(~F.col("g_orders").eqNullSafe(F.col("m_orders")) | ~F.col("g_late").eqNullSafe(F.col("m_late")))
                 .agg(N().alias("mismatches")))
    base = core.select(F.col("rows").alias("c_orders"), F.col("late").alias("c_late"))
    totals = cross_one_row(base, otdr.agg(F.sum("total_orders").alias("o"), F.sum("late_orders").alias("ol")),
                           sla_state.agg(F.sum("total_orders").alias("s"), F.sum("late_orders").alias("sl")),
                           sla_geo.agg(F.sum("total_orders").alias("g"), F.sum("late_orders").alias("gl")))
    tot_bad = (F.when(F.col("o") != F.col("c_orders"), 1).otherwise(0)
               + F.when(F.col("s") != F.col("c_orders"), 1).otherwise(0)
               + F.when(F.col("g") != F.col("c_orders"), 1).otherwise(0)
               + F.when(F.col("ol") != F.col("c_late"), 1).otherwise(0)
               + F.when(F.col("sl") != F.col("c_late"), 1).otherwise(0)
               + F.when(F.col("gl") != F.col("c_late"), 1).otherwise(0))

    def out(name: str, df: DataFrame, col: F.Column) -> DataFrame:
        return df.select(F.lit(name).alias("check"), col.cast("bigint").alias("mismatches")).withColumn(
            "passed", F.col("mismatches") == 0)

    return _union([
        out("geo_rows_sum_to_state_rows", bad_state, F.col("mismatches")),
        out("geo_rows_sum_to_month_rows", bad_month, F.col("mismatches")),
        out("kpi_totals_equal_clean_orders", totals, tot_bad),
    ])
