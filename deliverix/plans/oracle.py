"""DuckDB SQL for every job: the independent cross-check of the Spark plans.

Each statement starts from the driver's raw tables (``orders``, ``lineitem``,
``customer`` ...) and repeats the testdata mapping as CTEs.  From the Spark
side it takes only constants: the mappings, metric names and card lists.  Conventions that keep both engines bit-equal:

* sums of money or already-rounded values are taken as DECIMAL and cast to
  DOUBLE (order-independent);
* percentiles and standard deviations are rounded to 6 and then to the
  published number of digits (interpolation differs in the last bit);
* every integer sum is cast back to BIGINT.
"""

from __future__ import annotations

from deliverix.params import DEFAULT, Params
from deliverix.sources import testdata as td


def _case(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v!r}" if isinstance(v, str) else f"WHEN '{k}' THEN {v}"
                     for k, v in mapping.items())
    return f"CASE {col} {whens} END"


def _translations() -> str:
    rows = ", ".join(f"('{a}', '{b}')" for a, b in td.CATEGORY_TRANSLATIONS)
    return f"SELECT * FROM (VALUES {rows}) AS v(product_category_name, product_category_name_english)"


def base_ctes(p: Params) -> list[tuple[str, str]]:
    ship = """
        SELECT o.o_orderkey, min(l.l_shipdate) AS first_ship
        FROM orders o JOIN lineitem l
          ON l.l_orderkey = o.o_orderkey AND l.l_shipdate >= o.o_orderdate
        GROUP BY o.o_orderkey"""
    purchase = "o.o_orderdate + to_hours(CAST(o.o_orderkey % 24 AS BIGINT))"
    m_orders = f"""
        SELECT o.o_orderkey AS order_id,
               o.o_custkey AS customer_id,
               {_case('o.o_orderstatus', td.STATUS_BY_CODE)} AS order_status,
               {purchase} AS order_purchase_timestamp,
               {purchase} + INTERVAL 1 HOUR AS order_approved_at,
               s.first_ship + INTERVAL 12 HOUR - INTERVAL 1 DAY AS order_delivered_carrier_date,
               s.first_ship + INTERVAL 12 HOUR AS order_delivered_customer_date,
               o.o_orderdate + to_days({_case('o.o_orderpriority', td.PROMISE_DAYS_BY_PRIORITY)})
                   AS order_estimated_delivery_date
        FROM orders o LEFT JOIN m_ship s ON s.o_orderkey = o.o_orderkey"""
    m_customers = """
        SELECT c.c_custkey AS customer_id, c.c_custkey AS customer_unique_id,
               c.c_mktsegment AS customer_city, n.n_name AS customer_state
        FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey"""
    m_items = """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
               l_suppkey AS seller_id, l_extendedprice AS price,
               round(l_extendedprice * l_tax, 2) AS freight_value
        FROM lineitem"""
    m_products = f"""
        SELECT p_partkey AS product_id, nullif(p_type, '{td.UNCATEGORISED_TYPE}') AS product_category_name,
               CAST(p_size AS DOUBLE) * 100.0 AS product_weight_g,
               CAST(p_size AS DOUBLE) AS product_length_cm,
               CAST(p_size AS DOUBLE) AS product_height_cm,
               CAST(p_size AS DOUBLE) AS product_width_cm
        FROM part"""
    m_sellers = """
        SELECT s.s_suppkey AS seller_id, n.n_name AS seller_city, r.r_name AS seller_state
        FROM supplier s
        LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
        LEFT JOIN region r ON r.r_regionkey = n.n_regionkey"""
    m_reviews = f"""
        SELECT l_orderkey AS order_id, CAST(ceil(l_quantity / 10.0) AS INTEGER) AS review_score
        FROM lineitem WHERE l_returnflag = '{td.REVIEW_RETURN_FLAG}'"""
    m_regions = "SELECT n_name AS region_code FROM nation"

    ts = "CAST(o.order_purchase_timestamp AS TIMESTAMP)"
    dl = "CAST(o.order_delivered_customer_date AS TIMESTAMP)"
    es = "CAST(o.order_estimated_delivery_date AS TIMESTAMP)"
    clean = f"""
        SELECT o.order_id, o.customer_id, c.customer_unique_id, c.customer_state, c.customer_city,
               o.order_status,
               {ts} AS purchase_ts,
               CAST(o.order_approved_at AS TIMESTAMP) AS approved_ts,
               CAST(o.order_delivered_carrier_date AS TIMESTAMP) AS carrier_ts,
               {dl} AS delivered_ts,
               {es} AS estimated_ts,
               date_diff('day', {ts}, {dl}) AS actual_lead_time_days,
               date_diff('day', {ts}, {es}) AS promised_lead_time_days,
               date_diff('day', {dl}, {es}) AS days_early_late,
               greatest(date_diff('day', {es}, {dl}), 0) AS delay_days,
               CASE WHEN {dl} > {es} THEN 1 ELSE 0 END AS is_late,
               CASE WHEN o.order_delivered_customer_date IS NULL THEN 1 ELSE 0 END AS is_undelivered,
               date_trunc('month', {ts}) AS purchase_month,
               date_trunc('week', {ts}) AS purchase_week,
               extract('year' FROM {ts}) AS purchase_year,
               extract('month' FROM {ts}) AS purchase_month_num,
               extract('dow' FROM {ts}) AS day_of_week
        FROM m_orders o JOIN m_customers c ON c.customer_id = o.customer_id
        WHERE o.order_status = 'delivered'
          AND o.order_delivered_customer_date IS NOT NULL
          AND o.order_purchase_timestamp IS NOT NULL"""
    cat = "coalesce(t.product_category_name_english, p.product_category_name, 'Unknown')"
    line_cat = f"""
        SELECT oc.order_id, oc.customer_unique_id, oc.customer_state, oc.purchase_ts, oc.purchase_week,
               oc.actual_lead_time_days, oc.is_late,
               i.order_item_id, i.product_id, i.seller_id, i.price, i.freight_value,
               {cat} AS category_en, p.product_weight_g,
               p.product_length_cm * p.product_height_cm * p.product_width_cm / 1000000.0 AS volume_m3
        FROM orders_clean oc
        JOIN m_items i ON i.order_id = oc.order_id
        JOIN m_products p ON p.product_id = i.product_id
        LEFT JOIN m_translations t ON t.product_category_name = p.product_category_name"""
    return [
        ("m_ship", ship), ("m_orders", m_orders), ("m_customers", m_customers), ("m_items", m_items),
        ("m_products", m_products), ("m_translations", _translations()), ("m_sellers", m_sellers),
        ("m_reviews", m_reviews), ("m_regions", m_regions), ("orders_clean", clean),
        ("line_cat", line_cat),
    ]


def _r(expr: str, n: int) -> str:
    return f"round({expr}, {n})"


def _rs(expr: str, n: int) -> str:
    return f"round(round({expr}, 6), {n})"


def _pct(num: str, den: str) -> str:
    return f"100.0::DOUBLE * ({num}) / ({den})"


def _xavg(col: str, scale: int = 2) -> str:
    return f"CAST(sum(CAST({col} AS DECIMAL(18,{scale}))) AS DOUBLE) / count({col})"


def kpi_ctes(p: Params) -> list[tuple[str, str]]:
    late = "CAST(sum(is_late) AS BIGINT)"
    otdr = f"""
        SELECT purchase_month, count(*) AS total_orders, {late} AS late_orders,
               count(*) - {late} AS on_time_orders,
               {_r(_pct(f'count(*) - {late}', 'count(*)'), 2)} AS otdr_pct,
               {_r('avg(CASE WHEN is_late = 1 THEN delay_days END)', 1)} AS avg_delay_when_late_days,
               {_rs('quantile_cont(actual_lead_time_days, 0.95)', 1)} AS p95_lead_time
        FROM orders_clean GROUP BY purchase_month"""
    order_cat = """
        SELECT DISTINCT order_id, category_en, actual_lead_time_days, is_late FROM line_cat"""
    lead_cat = f"""
        SELECT category_en, count(*) AS total_orders,
               {_r('avg(actual_lead_time_days)', 1)} AS avg_lead_time,
               {_rs('quantile_cont(actual_lead_time_days, 0.5)', 1)} AS median_lead_time,
               {_rs('quantile_cont(actual_lead_time_days, 0.75)', 1)} AS p75_lead_time,
               {_rs('quantile_cont(actual_lead_time_days, 0.9)', 1)} AS p90_lead_time,
               {_rs('quantile_cont(actual_lead_time_days, 0.99)', 1)} AS p99_lead_time,
               {_rs('stddev_samp(actual_lead_time_days)', 1)} AS lead_time_std,
               {_r(_pct(late, 'count(*)'), 1)} AS late_rate_pct
        FROM k_order_cat GROUP BY category_en HAVING count(*) >= {p.min_category_orders}"""
    lead_detail = """
        SELECT DISTINCT order_id, category_en, actual_lead_time_days FROM line_cat
        WHERE actual_lead_time_days IS NOT NULL"""
    review_order = "SELECT order_id, avg(review_score) AS review_score FROM m_reviews GROUP BY order_id"
    seller_order = """
        SELECT s.seller_id, s.seller_state, s.seller_city, oc.order_id, oc.actual_lead_time_days, oc.is_late,
               sum(CAST(i.price AS DECIMAL(18,2))) AS order_gmv, max(r.review_score) AS review_score
        FROM orders_clean oc
        JOIN m_items i ON i.order_id = oc.order_id
        JOIN m_sellers s ON s.seller_id = i.seller_id
        LEFT JOIN k_review_order r ON r.order_id = oc.order_id
        GROUP BY s.seller_id, s.seller_state, s.seller_city, oc.order_id, oc.actual_lead_time_days, oc.is_late"""
    bad = f"CAST(sum(CASE WHEN review_score <= {p.bad_review_max} THEN 1 ELSE 0 END) AS BIGINT)"
    late_pct = _pct(late, "count(*)")
    composite = (f"(100.0::DOUBLE - {late_pct}) * 0.5::DOUBLE "
                 f"+ (coalesce(avg(review_score), 0.0::DOUBLE) / 5.0::DOUBLE * 100.0::DOUBLE) * 0.5::DOUBLE")
    seller = f"""
        SELECT seller_id, seller_state, seller_city, count(*) AS total_orders,
               round(CAST(sum(order_gmv) AS DOUBLE), 0) AS total_gmv,
               {_r('avg(actual_lead_time_days)', 1)} AS avg_lead_time,
               {_r(late_pct, 1)} AS late_rate_pct,
               {_r('avg(review_score)', 2)} AS avg_review_score,
               {bad} AS bad_reviews,
               {_r(_pct(bad, 'count(*)'), 1)} AS bad_review_rate_pct,
               {_r(composite, 1)} AS seller_composite_score
        FROM k_seller_order GROUP BY seller_id, seller_state, seller_city
        HAVING count(*) >= {p.min_seller_orders}"""
    sla_geo = f"""
        SELECT customer_state, purchase_month, count(*) AS total_orders, {late} AS late_orders,
               {_r(_pct(late, 'count(*)'), 1)} AS breach_rate_pct,
               {_r('avg(CASE WHEN is_late = 1 THEN delay_days END)', 1)} AS avg_delay_days,
               {_r('avg(actual_lead_time_days)', 1)} AS avg_lead_time
        FROM orders_clean GROUP BY customer_state, purchase_month"""
    sla_state = f"""
        SELECT customer_state, count(*) AS total_orders, {late} AS late_orders,
               {_r(_pct(late, 'count(*)'), 1)} AS breach_rate_pct,
               {_r('avg(actual_lead_time_days)', 1)} AS avg_lead_time,
               {_r('avg(CASE WHEN is_late = 1 THEN delay_days END)', 1)} AS avg_delay_when_late
        FROM orders_clean GROUP BY customer_state"""
    first = """
        SELECT customer_unique_id, date_trunc('month', min(purchase_ts)) AS cohort_month
        FROM orders_clean GROUP BY customer_unique_id"""
    cohort_size = "SELECT cohort_month, count(*) AS cohort_customers FROM k_first GROUP BY cohort_month"
    activity = """
        SELECT oc.customer_unique_id, f.cohort_month,
               date_diff('month', f.cohort_month, date_trunc('month', oc.purchase_ts)) AS month_number
        FROM orders_clean oc JOIN k_first f ON f.customer_unique_id = oc.customer_unique_id"""
    cohort = f"""
        SELECT a.cohort_month, a.month_number, s.cohort_customers,
               count(DISTINCT a.customer_unique_id) AS active_customers,
               {_r(_pct('count(DISTINCT a.customer_unique_id)', 's.cohort_customers'), 1)} AS retention_rate_pct
        FROM k_activity a JOIN k_cohort_size s ON s.cohort_month = a.cohort_month
        WHERE a.cohort_month >= TIMESTAMP '{p.cohort_start}' AND a.month_number <= {p.cohort_max_month}
        GROUP BY a.cohort_month, a.month_number, s.cohort_customers"""
    volume = f"""
        SELECT oc.purchase_week, count(DISTINCT oc.order_id) AS orders,
               count(DISTINCT oc.customer_unique_id) AS unique_customers,
               round(CAST(sum(CAST(i.price + i.freight_value AS DECIMAL(18,2))) AS DOUBLE), 0) AS total_gmv,
               {_r(_xavg('i.price'), 2)} AS avg_item_price,
               {_r(_xavg('i.freight_value'), 2)} AS avg_freight,
               round(avg(i.freight_value / nullif(i.price, 0)) * 100, 1) AS freight_pct_of_price
        FROM orders_clean oc JOIN m_items i ON i.order_id = oc.order_id
        GROUP BY oc.purchase_week"""
    velocity = f"""
        SELECT category_en, count(order_item_id) AS units_sold, count(DISTINCT order_id) AS orders,
               round(CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE), 0) AS total_revenue,
               {_r(_xavg('price'), 2)} AS avg_unit_price,
               round(CAST(count(order_item_id) AS DOUBLE)
                     / CAST(nullif(date_diff('week', min(purchase_ts), max(purchase_ts)), 0) AS DOUBLE), 1)
                   AS units_per_week,
               round({_xavg('product_weight_g')} / 1000.0, 2) AS avg_weight_kg,
               round({_xavg('volume_m3', 6)}, 3) AS avg_volume_m3
        FROM line_cat GROUP BY category_en"""
    freight = f"""
        SELECT s.seller_state, lc.customer_state, lc.category_en, count(*) AS shipments,
               {_r(_xavg('lc.freight_value'), 2)} AS avg_freight_cost,
               {_r(_xavg('lc.price'), 2)} AS avg_item_value,
               round(avg(lc.freight_value / nullif(lc.price, 0)) * 100, 1) AS freight_pct_of_value,
               {_r('avg(lc.actual_lead_time_days)', 1)} AS avg_lead_time,
               {_r(_pct('CAST(sum(lc.is_late) AS BIGINT)', 'count(*)'), 1)} AS late_rate_pct
        FROM line_cat lc JOIN m_sellers s ON s.seller_id = lc.seller_id
        WHERE lc.freight_value > 0
        GROUP BY s.seller_state, lc.customer_state, lc.category_en
        HAVING count(*) >= {p.min_lane_shipments}"""
    return [
        ("k_otdr", otdr), ("k_order_cat", order_cat), ("k_lead_category", lead_cat),
        ("k_lead_detail", lead_detail), ("k_review_order", review_order), ("k_seller_order", seller_order),
        ("k_seller", seller), ("k_sla_geo", sla_geo), ("k_sla_state", sla_state), ("k_first", first),
        ("k_cohort_size", cohort_size), ("k_activity", activity), ("k_cohort", cohort),
        ("k_volume", volume), ("k_velocity", velocity), ("k_freight", freight),
    ]


def _r_even(expr: str, n: int) -> str:
    """Half to even on the exact value of a double from 0 on: as an integer of 2^-60ths, in integer arithmetic."""
    one = 2 ** 60
    scaled = f"(CAST(({expr}) * {one}.0::DOUBLE AS HUGEINT) * {10 ** n})"
    down, rest = f"({scaled} // {one})", f"({scaled} % {one})"
    up = f"CASE WHEN {rest} > {one // 2} OR ({rest} = {one // 2} AND {down} % 2 = 1) THEN 1 ELSE 0 END"
    return f"CAST({down} + {up} AS DOUBLE) / {10 ** n}.0::DOUBLE"


def _pr(v: str) -> str:
    """Average-tie percent rank of ``v``."""
    return (f"((CAST(rank() OVER (ORDER BY {v}) AS DOUBLE) - 1.0::DOUBLE) "
            f"+ (CAST(count(*) OVER (PARTITION BY {v}) AS DOUBLE) + 1.0::DOUBLE) / 2.0::DOUBLE) "
            f"/ CAST(count({v}) OVER () AS DOUBLE)")


def _hi(expr: str, scale: int) -> str:
    """Rounded value as an exact integer (value x 10^scale)."""
    if scale:
        expr = f"round({expr} * {float(10 ** scale)}::DOUBLE)"
    return f"CAST({expr} AS HUGEINT)"


def derived_ctes(p: Params) -> list[tuple[str, str]]:
    from deliverix.operators.summary import METRICS, TEXT_METRICS
    from deliverix.operators.views import CARD_METRICS, QUALITY_CHECKS, SNAPSHOT_METRICS

    route = f"""
        SELECT seller_state, customer_state, CAST(sum(shipments) AS BIGINT) AS shipments,
               {_xavg('avg_freight_cost', 2)} AS avg_freight_cost,
               {_xavg('avg_lead_time', 1)} AS avg_lead_time,
               {_xavg('late_rate_pct', 1)} AS late_rate_pct,
               {_xavg('freight_pct_of_value', 1)} AS freight_pct_of_value
        FROM k_freight GROUP BY seller_state, customer_state
        HAVING sum(shipments) >= {p.min_corridor_shipments}"""
    corridors = f"""
        SELECT *, {_pr('avg_freight_cost')} * 0.5::DOUBLE + {_pr('late_rate_pct')} * 0.5::DOUBLE AS cost_late_index
        FROM d_route"""
    overall = f"""
        SELECT {_r(_pct('sum(1 - is_late)', 'count(*)'), 2)} AS overall_otdr_pct FROM orders_clean"""
    rep = f"""
        SELECT *, row_number() OVER (ORDER BY purchase_month) - 1 AS month_index
        FROM k_otdr WHERE total_orders >= {p.min_month_orders}"""
    x, y = _hi("month_index", 0), _hi("otdr_pct", 2)
    trend_sums = f"""
        SELECT CAST(count(*) AS HUGEINT) AS n, sum({x}) AS sx, sum({y}) AS sy,
               sum({x} * {x}) AS sxx, sum({x} * {y}) AS sxy,
               min(otdr_pct) AS otdr_min_pct, max(otdr_pct) AS otdr_max_pct
        FROM d_rep"""
    trend = f"""
        SELECT CAST(n AS BIGINT) AS reporting_months, slope AS otdr_slope_pct_per_month,
               otdr_min_pct, otdr_max_pct,
               (SELECT strftime(purchase_month, '%Y-%m') FROM d_rep
                ORDER BY otdr_pct, purchase_month LIMIT 1) AS worst_otdr_month,
               otdr_min_pct AS worst_otdr_pct,
               CASE WHEN slope > 0 THEN 'improving' ELSE 'deteriorating' END AS otdr_trend_direction,
               CAST({p.min_month_orders} AS BIGINT) AS otdr_reporting_month_threshold
        FROM (SELECT *, CAST(n * sxy - sx * sy AS DOUBLE) / nullif(CAST(n * sxx - sx * sx AS DOUBLE), 0)
                        / 100.0::DOUBLE AS slope
              FROM d_trend_sums)"""
    seller_rank = f"""
        SELECT *, row_number() OVER (ORDER BY seller_composite_score, seller_id) AS rn,
               greatest(1, CAST(ceil(CAST(count(*) OVER () AS DOUBLE) * {p.bottom_share}::DOUBLE) AS BIGINT)) AS k
        FROM k_seller"""
    late = "CAST(total_orders AS DECIMAL(38,0)) * CAST(late_rate_pct AS DECIMAL(18,1))"
    bottom = f"""
        SELECT count(*) AS scored_sellers,
               count(*) FILTER (WHERE rn <= k) AS bottom_seller_count,
               {_r_even(f"100.0::DOUBLE * CAST(sum(CASE WHEN rn <= k THEN {late} END) AS DOUBLE) / CAST(sum({late}) AS DOUBLE)", 1)}
                 AS bottom_seller_breach_share_pct,
               {_r_even("100.0::DOUBLE * CAST(sum(CASE WHEN rn <= k THEN total_orders END) AS DOUBLE) / CAST(sum(total_orders) AS DOUBLE)", 1)}
                 AS bottom_seller_order_share_pct
        FROM d_seller_rank"""
    cx, cy = _hi("avg_lead_time", 1), _hi("breach_rate_pct", 1)
    corr_sums = f"""
        SELECT CAST(count(*) AS HUGEINT) AS n, sum({cx}) AS sx, sum({cy}) AS sy, sum({cx} * {cx}) AS sxx,
               sum({cy} * {cy}) AS syy, sum({cx} * {cy}) AS sxy
        FROM k_sla_state"""
    corr = """
        SELECT CAST(n AS BIGINT) AS n_states,
               CAST(n * sxy - sx * sy AS DOUBLE)
               / nullif(sqrt(CAST(n * sxx - sx * sx AS DOUBLE) * CAST(n * syy - sy * sy AS DOUBLE)), 0)
                 AS state_breach_corr
        FROM d_corr_sums"""
    step = ("{'term': acc.term * c2 * ratio_k, 'total': acc.total + acc.term * c2 * ratio_k}")
    ratio_k = ("(CASE WHEN odd THEN CAST(2 * k AS DOUBLE) / (CAST(2 * k AS DOUBLE) + 1.0::DOUBLE) "
               "ELSE (CAST(2 * k AS DOUBLE) - 1.0::DOUBLE) / CAST(2 * k AS DOUBLE) END)")
    step = step.replace("ratio_k", ratio_k)
    # Near zero correlation the finite series in the angle, elsewhere the tail as a series of positive
    # terms (both for whole degrees of freedom): not the continued fraction of the engine.
    tail_step = ("{'term': acc.term * c2 * (nu - 1 + 2 * k) / CAST(nu + 2 * k AS DOUBLE), "
                 "'total': acc.total + acc.term * c2 * (nu - 1 + 2 * k) / CAST(nu + 2 * k AS DOUBLE)}")
    one = "{'term': 1.0::DOUBLE, 'total': 1.0::DOUBLE}"
    corr_p = f"""
        SELECT n_states, state_breach_corr,
               CASE WHEN state_breach_corr IS NULL OR n_states < 3 THEN CAST(NULL AS DOUBLE)
                    WHEN ar >= 1.0 THEN 0.0::DOUBLE
                    WHEN ar >= 0.1 THEN CAST(format('{{:.11e}}', 2.0::DOUBLE / beta * ar * pow(c2, nu / 2.0::DOUBLE) / nu
                         * list_reduce(range(1, CAST(ceil(45.0 / (ar * ar)) AS INTEGER)), lambda acc, k: {tail_step}, {one}).total) AS DOUBLE)
                    ELSE CAST(format('{{:.11e}}', 1.0::DOUBLE - CASE WHEN odd
                         THEN (asin(ar) + CASE WHEN nu >= 3 THEN ar * sqrt(c2) * total ELSE 0.0::DOUBLE END) * 2.0::DOUBLE / pi()
                         ELSE ar * total END) AS DOUBLE)
               END AS state_breach_corr_pvalue
        FROM (SELECT *, list_reduce(CASE WHEN k_max >= 1 THEN range(1, k_max + 1) ELSE [] END, lambda acc, k: {step}, {one}).total AS total,
                     CASE WHEN odd THEN list_reduce(range(1, (nu - 1) // 2 + 1), lambda acc, k: acc * (2 * k - 1) / (2 * k), pi())
                          ELSE list_reduce(range(1, nu // 2), lambda acc, k: acc * (2 * k) / (2 * k + 1), 2.0::DOUBLE) END AS beta
              FROM (SELECT *, CASE WHEN odd THEN (nu - 3) // 2 ELSE (nu - 2) // 2 END AS k_max
                    FROM (SELECT *, CAST(n_states - 2 AS INTEGER) AS nu,
                                 (n_states - 2) % 2 = 1 AS odd, abs(state_breach_corr) AS ar,
                                 (1.0::DOUBLE - state_breach_corr) * (1.0::DOUBLE + state_breach_corr) AS c2
                          FROM d_corr)))"""
    matrix = ("SELECT cohort_month, "
              + ", ".join(f"max(CASE WHEN month_number = {m} THEN retention_rate_pct END) AS m{m}"
                          for m in range(p.cohort_max_month + 1))
              + " FROM k_cohort GROUP BY cohort_month")

    def at(m: int) -> str:
        v = f"CASE WHEN month_number = {m} THEN retention_rate_pct END"
        return f"{_r_even(_xavg(v, 1), 2)} AS retention_m{m}_pct"

    def pick(order: str) -> str:
        return (f"coalesce((SELECT strftime(cohort_month, '%Y-%m') FROM k_cohort WHERE month_number = 3 "
                f"ORDER BY {order}, cohort_month LIMIT 1), 'NA')")

    retention = f"""
        SELECT {at(1)}, {at(3)}, {at(6)}, {at(12)},
               {pick('retention_rate_pct DESC')} AS best_m3_cohort,
               max(CASE WHEN month_number = 3 THEN retention_rate_pct END) AS best_m3_retention_pct,
               {pick('retention_rate_pct')} AS worst_m3_cohort,
               min(CASE WHEN month_number = 3 THEN retention_rate_pct END) AS worst_m3_retention_pct
        FROM k_cohort"""
    order_value = """
        SELECT oc.order_id, oc.customer_unique_id,
               sum(CAST(i.price + i.freight_value AS DECIMAL(18,2))) AS order_value
        FROM orders_clean oc JOIN m_items i ON i.order_id = oc.order_id
        GROUP BY oc.order_id, oc.customer_unique_id"""
    ltv = """
        SELECT a.avg_orders_per_customer, b.average_order_value,
               a.avg_orders_per_customer * b.average_order_value AS ltv_proxy
        FROM (SELECT CAST(sum(lifetime_orders) AS DOUBLE) / count(*) AS avg_orders_per_customer
              FROM (SELECT customer_unique_id, count(*) AS lifetime_orders FROM d_order_value
                    GROUP BY customer_unique_id)) a
        CROSS JOIN (SELECT CAST(sum(order_value) AS DOUBLE) / count(order_value) AS average_order_value
                    FROM d_order_value) b"""
    financials = """
        SELECT count(*) AS total_orders, CAST(sum(order_value) AS DOUBLE) AS total_gmv,
               CAST(sum(order_value) AS DOUBLE) / count(order_value) AS aov
        FROM d_order_value"""
    wow = """
        SELECT *, (CAST(orders AS DOUBLE) / CAST(lag(orders) OVER (ORDER BY purchase_week) AS DOUBLE)
                   - 1.0::DOUBLE) * 100.0::DOUBLE AS wow_order_growth_pct
        FROM k_volume"""
    top_weeks = """
        SELECT v.purchase_week, v.orders, v.total_gmv, v.total_gmv / CAST(v.orders AS DOUBLE) AS aov,
               CASE WHEN CAST(v.orders AS DOUBLE) > m.med THEN 'High order volume'
                    ELSE 'Higher AOV/item mix' END AS driver
        FROM (SELECT * FROM k_volume ORDER BY total_gmv DESC, purchase_week LIMIT 3) v
        CROSS JOIN (SELECT quantile_cont(orders, 0.5) AS med FROM k_volume) m"""
    wpm = f"{p.weeks_per_month}::DOUBLE"
    demand = "v.units_per_week * l.avg_lead_time / 7.0::DOUBLE"
    velocity_inv = f"""
        SELECT v.*, l.avg_lead_time, l.p90_lead_time,
               v.units_per_week * {wpm} AS monthly_units,
               {demand} AS lead_time_demand_units,
               v.units_per_week * {wpm} AS reorder_point_units,
               coalesce({demand} > v.units_per_week * {wpm}, false) AS stockout_risk
        FROM k_velocity v LEFT JOIN k_lead_category l ON l.category_en = v.category_en"""
    median = "SELECT round(quantile_cont(avg_freight_cost, 0.5), 6) AS median_freight_cost FROM k_freight"
    metric_row = ("SELECT * FROM d_overall, d_trend, d_bottom, d_corr_p, d_retention, d_ltv, d_financials, "
                  "d_median")
    parts = []
    for pos, name in enumerate(METRICS, start=1):
        if name in TEXT_METRICS:
            parts.append(f"SELECT {pos} AS position, '{name}' AS metric, CAST(NULL AS DOUBLE) AS value_num, "
                         f"CAST({name} AS VARCHAR) AS value_text, CAST({name} AS VARCHAR) AS value FROM d_metric_row")
        else:
            plain = f"CAST(CAST(CAST({name} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,12))"
            parts.append(f"SELECT {pos} AS position, '{name}' AS metric, CAST({name} AS DOUBLE) AS value_num, "
                         f"CAST(NULL AS VARCHAR) AS value_text, "
                         f"CASE WHEN {name} <> 0 AND abs({name}) < 1e-6 "
                         f"THEN regexp_replace(regexp_replace(format('{{:.11e}}', CAST({name} AS DOUBLE)), '0+e', 'e'), '\\.e', 'e') "
                         f"ELSE rtrim(rtrim(CAST({plain} AS VARCHAR), '0'), '.') END AS value FROM d_metric_row")
    metrics_all = "\n        UNION ALL ".join(parts)
    metrics = "SELECT * FROM d_metrics_all WHERE metric <> 'state_breach_corr_pvalue'"

    val_row = """
        SELECT o.null_ids, o.dmin, o.dmax, o.orig_rows, a.orphans, c.clean_rows, c.cmin, c.cmax
        FROM (SELECT count(*) FILTER (WHERE order_id IS NULL) AS null_ids,
                     min(order_purchase_timestamp) AS dmin, max(order_purchase_timestamp) AS dmax,
                     count(*) AS orig_rows FROM m_orders) o,
             (SELECT count(*) AS orphans FROM m_items i
              WHERE NOT EXISTS (SELECT 1 FROM m_orders o2 WHERE o2.order_id = i.order_id)) a,
             (SELECT count(*) AS clean_rows, min(purchase_ts) AS cmin, max(purchase_ts) AS cmax
              FROM orders_clean) c"""

    def vnum(name: str, expr: str) -> str:
        return (f"SELECT '{name}' AS \"check\", CAST({expr} AS DOUBLE) AS value_num, "
                f"CAST(NULL AS VARCHAR) AS value_text FROM d_val_row")

    def vtxt(name: str, col: str) -> str:
        return (f"SELECT '{name}' AS \"check\", CAST(NULL AS DOUBLE) AS value_num, "
                f"strftime({col}, '%Y-%m-%d %H:%M:%S') AS value_text FROM d_val_row")

    validation = "\n        UNION ALL ".join([
        vnum("null_order_ids", "null_ids"), vtxt("date_coverage_min", "dmin"), vtxt("date_coverage_max", "dmax"),
        vnum("items_without_order", "orphans"), vnum("orders_clean_rows", "clean_rows"),
        vtxt("orders_clean_date_min", "cmin"), vtxt("orders_clean_date_max", "cmax"),
        vnum("orders_clean_retention_pct", _r_even("100.0::DOUBLE * clean_rows / orig_rows", 2)),
    ])
    required = ["overall_otdr_pct", "bottom_seller_breach_share_pct", "retention_m1_pct",
                "retention_m3_pct", "total_orders", "total_gmv"]
    req = ", ".join(f"'{m}'" for m in required)
    gate_row = f"""
        SELECT * FROM
          (SELECT count(*) AS clean_rows FROM orders_clean) r,
          (SELECT count(*) FILTER (WHERE metric IN ({req})) AS present,
                  max(CASE WHEN metric = 'total_orders' THEN value_num END) AS s_orders,
                  max(CASE WHEN metric = 'overall_otdr_pct' THEN value_num END) AS s_otdr FROM d_metrics) m,
          (SELECT count(*) AS m0_rows,
                  count(*) FILTER (WHERE retention_rate_pct <> 100.0 OR active_customers <> cohort_customers)
                    AS m0_bad
           FROM k_cohort WHERE month_number = 0) c,
          (SELECT count(*) AS st_rows, count(DISTINCT customer_state) AS st_distinct,
                  count(*) FILTER (WHERE NOT (breach_rate_pct BETWEEN 0 AND 100)) AS st_bad_rate,
                  sum(total_orders) AS st_orders FROM k_sla_state) s,
          (SELECT sum(total_orders) AS o_orders, sum(late_orders) AS o_late FROM k_otdr) o,
          (SELECT bottom_seller_breach_share_pct AS share, bottom_seller_order_share_pct AS oshare FROM d_bottom) b,
          (SELECT count(*) FILTER (WHERE c > 1) AS dup_c
           FROM (SELECT customer_id, count(*) AS c FROM m_customers GROUP BY customer_id)) dc,
          (SELECT count(*) FILTER (WHERE c > 1) AS dup_t
           FROM (SELECT product_category_name, count(*) AS c FROM m_translations
                 GROUP BY product_category_name)) dt,
          (SELECT count(*) FILTER (WHERE c > 1) AS dup_p
           FROM (SELECT product_id, count(*) AS c FROM m_products GROUP BY product_id)) dp,
          (SELECT count(*) FILTER (WHERE c > 1) AS dup_s
           FROM (SELECT seller_id, count(*) AS c FROM m_sellers GROUP BY seller_id)) ds"""
    mr = float(p.min_clean_rows)
    exp_otdr = "round(100.0::DOUBLE * CAST(o_orders - o_late AS DOUBLE) / CAST(o_orders AS DOUBLE), 2)"

    def g(name: str, observed: str, threshold: str, passed: str, detail: str = "NULL") -> str:
        return (f"SELECT '{name}' AS expectation, CAST({observed} AS DOUBLE) AS observed, "
                f"CAST({threshold} AS DOUBLE) AS threshold, coalesce({passed}, false) AS passed, "
                f"CAST({detail} AS VARCHAR) AS detail FROM d_gate_row")

    gates = "\n        UNION ALL ".join([
        g("orders_clean_min_rows", "clean_rows", str(mr), f"clean_rows >= {mr}"),
        g("required_metrics_present", "present", str(float(len(required))), f"present = {len(required)}",
          f"(SELECT string_agg(x, ',') FROM (SELECT unnest([{req}]) AS x) WHERE x NOT IN (SELECT metric FROM d_metrics))"),
        g("summary_total_orders_min", "s_orders", str(mr), f"s_orders >= {mr}"),
        g("summary_total_orders_equals_otdr", "s_orders", "o_orders", "s_orders = CAST(o_orders AS DOUBLE)"),
        g("summary_otdr_equals_otdr_table", "s_otdr", exp_otdr, f"s_otdr = {exp_otdr}"),
        g("cohort_month0_full_retention", "m0_bad", "0.0", "m0_bad = 0 AND m0_rows > 0"),
        g("bottom_breach_share_above_order_share", "share", "oshare", "share > oshare"),
        g("bottom_breach_share_min", "share", str(p.min_breach_share), f"share >= {p.min_breach_share}"),
        g("state_rows_unique", "st_distinct", "st_rows", "st_distinct = st_rows"),
        g("state_breach_rate_in_0_100", "st_bad_rate", "0.0", "st_bad_rate = 0"),
        g("state_orders_min", "st_orders", str(mr), f"st_orders >= {mr}"),
        g("orders_unique", "(SELECT count(*) FROM (SELECT order_id FROM m_orders GROUP BY order_id HAVING count(*) > 1))", "0.0",
          "NOT EXISTS (SELECT 1 FROM m_orders GROUP BY order_id HAVING count(*) > 1)"),
        g("customers_unique", "dup_c", "0.0", "dup_c = 0"),
        g("translations_unique", "dup_t", "0.0", "dup_t = 0"),
        g("products_unique", "dup_p", "0.0", "dup_p = 0"),
        g("sellers_unique", "dup_s", "0.0", "dup_s = 0"),
    ])
    consistency = """
        SELECT "check", mismatches, mismatches = 0 AS passed FROM (
          SELECT 'geo_rows_sum_to_state_rows' AS "check", count(*) AS mismatches
          FROM (SELECT customer_state, sum(total_orders) AS g_orders, sum(late_orders) AS g_late
                FROM k_sla_geo GROUP BY customer_state) g
          FULL JOIN k_sla_state s ON s.customer_state = g.customer_state
          WHERE g.g_orders IS DISTINCT FROM s.total_orders OR g.g_late IS DISTINCT FROM s.late_orders
          UNION ALL
          SELECT 'geo_rows_sum_to_month_rows', count(*)
          FROM (SELECT purchase_month, sum(total_orders) AS g_orders, sum(late_orders) AS g_late
                FROM k_sla_geo GROUP BY purchase_month) g
          FULL JOIN k_otdr m ON m.purchase_month = g.purchase_month
          WHERE g.g_orders IS DISTINCT FROM m.total_orders OR g.g_late IS DISTINCT FROM m.late_orders
          UNION ALL
          SELECT 'kpi_totals_equal_clean_orders',
                 CAST((o <> c_orders)::INT + (s <> c_orders)::INT + (g <> c_orders)::INT
                      + (ol <> c_late)::INT + (sl <> c_late)::INT + (gl <> c_late)::INT AS BIGINT)
          FROM (SELECT count(*) AS c_orders, sum(is_late) AS c_late FROM orders_clean),
               (SELECT sum(total_orders) AS o, sum(late_orders) AS ol FROM k_otdr),
               (SELECT sum(total_orders) AS s, sum(late_orders) AS sl FROM k_sla_state),
               (SELECT sum(total_orders) AS g, sum(late_orders) AS gl FROM k_sla_geo))"""
    cards = "\n        UNION ALL ".join([
        f"SELECT '{panel}' AS panel, metric AS name, value_num, value_text FROM d_metrics "
        f"WHERE metric IN ({', '.join(repr(m) for m in keys)})"
        for panel, keys in (("card", CARD_METRICS), ("snapshot", SNAPSHOT_METRICS))
    ] + [f"SELECT 'quality' AS panel, \"check\" AS name, value_num, value_text FROM d_validation "
         f"WHERE \"check\" IN ({', '.join(repr(c) for c in QUALITY_CHECKS)})"])
    return [
        ("d_route", route), ("d_corridors", corridors), ("d_overall", overall), ("d_rep", rep),
        ("d_trend_sums", trend_sums), ("d_trend", trend), ("d_seller_rank", seller_rank), ("d_bottom", bottom),
        ("d_corr_sums", corr_sums), ("d_corr", corr), ("d_corr_p", corr_p), ("d_matrix", matrix), ("d_retention", retention),
        ("d_order_value", order_value), ("d_ltv", ltv), ("d_financials", financials), ("d_wow", wow),
        ("d_top_weeks", top_weeks), ("d_velocity_inventory", velocity_inv), ("d_median", median),
        ("d_metric_row", metric_row), ("d_metrics_all", metrics_all), ("d_metrics", metrics), ("d_val_row", val_row),
        ("d_validation", validation), ("d_gate_row", gate_row), ("d_gates", gates),
        ("d_consistency", consistency), ("d_cards", cards),
    ]


def _extremes(table: str, value: str, key: str, cols: str, n: int = 5) -> str:
    return (f"SELECT * FROM (SELECT 'top' AS extreme, {cols} FROM {table} "
            f"ORDER BY {value} DESC NULLS LAST, {key} LIMIT {n}) "
            f"UNION ALL SELECT * FROM (SELECT 'bottom' AS extreme, {cols} FROM {table} "
            f"ORDER BY {value} ASC NULLS FIRST, {key} DESC LIMIT {n})")


def _final(p: Params) -> dict[str, str]:
    canon = ["orders", "customers", "items", "products", "translations", "sellers", "reviews"]
    ingest = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM m_{t}" for t in canon)
    ingest += " UNION ALL SELECT 'geo', count(*) FROM m_regions"
    exports = {
        "kpi_summary": "SELECT count(*) FROM d_metrics_all",
        "otdr": "SELECT count(*) FROM k_otdr", "lead_category": "SELECT count(*) FROM k_lead_category",
        "lead_time_detail": "SELECT count(*) FROM k_lead_detail", "seller": "SELECT count(*) FROM k_seller",
        "sla_geo": "SELECT count(*) FROM k_sla_geo", "sla_state": "SELECT count(*) FROM k_sla_state",
        "cohort": "SELECT count(*) FROM k_cohort", "volume": "SELECT count(*) FROM d_wow",
        "velocity": "SELECT count(*) FROM d_velocity_inventory", "freight": "SELECT count(*) FROM k_freight",
        "corridors": "SELECT count(*) FROM d_corridors",
        # 6 checks, and per distribution a blank line, a title, a header and its rows
        "schema_validation": "SELECT 12 + (SELECT count(DISTINCT order_status) FROM m_orders) "
                             "+ (SELECT count(DISTINCT review_score) FROM m_reviews)",
    }
    export = " UNION ALL ".join(f"SELECT '{k}' AS table_name, CAST(({v}) AS BIGINT) AS rows"
                                for k, v in exports.items())
    ci_base = f"""
        SELECT purchase_month, total_orders, otdr_pct,
               CAST(sum(CAST(otdr_pct AS DECIMAL(18,2))) OVER w AS DOUBLE) / count(otdr_pct) OVER w
                 AS otdr_rolling_pct,
               {p.ci_z}::DOUBLE * sqrt(otdr_pct / 100.0::DOUBLE * (1.0::DOUBLE - otdr_pct / 100.0::DOUBLE)
                                       / CAST(total_orders AS DOUBLE)) * 100.0::DOUBLE AS ci_half_width
        FROM k_otdr
        WINDOW w AS (ORDER BY purchase_month ROWS BETWEEN {p.rolling_rows - 1} PRECEDING AND CURRENT ROW)"""
    bins = p.histogram_bins
    hist = f"""
        WITH st AS (
            SELECT CASE WHEN max(s) = min(s) THEN min(s) - 0.5::DOUBLE ELSE min(s) END AS lo,
                   CASE WHEN max(s) = min(s) THEN max(s) + 0.5::DOUBLE ELSE max(s) END AS hi,
                   round(quantile_cont(s, {p.bottom_share}), 6) AS bottom_decile_cutoff
            FROM (SELECT seller_composite_score AS s FROM k_seller)),
        edges AS (
            SELECT b.bin,
                   st.lo + CAST(b.bin - 1 AS DOUBLE) * ((st.hi - st.lo) / {float(bins)}::DOUBLE) AS bin_low,
                   CASE WHEN b.bin = {bins} THEN st.hi
                        ELSE st.lo + CAST(b.bin AS DOUBLE) * ((st.hi - st.lo) / {float(bins)}::DOUBLE) END AS bin_high,
                   st.bottom_decile_cutoff
            FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(1, {bins + 1})) b CROSS JOIN st),
        cnt AS (
            SELECT e.bin, count(*) AS sellers
            FROM k_seller k JOIN edges e
              ON k.seller_composite_score >= e.bin_low
             AND (k.seller_composite_score < e.bin_high OR e.bin = {bins})
            GROUP BY e.bin)
        SELECT e.bin, e.bin_low, e.bin_high, coalesce(c.sellers, 0) AS sellers,
               e.bin_low < e.bottom_decile_cutoff AS in_bottom_span, e.bottom_decile_cutoff
        FROM edges e LEFT JOIN cnt c ON c.bin = e.bin"""
    top_cat = (f"SELECT category_en FROM k_lead_category ORDER BY total_orders DESC, category_en "
               f"LIMIT {p.top_categories}")
    impact = f"""
        SELECT total_late_orders,
               CAST(round_even(CAST(total_late_orders AS DOUBLE) * share / 100.0::DOUBLE
                               * {p.seller_late_cut}::DOUBLE, 0) AS BIGINT) AS bottom_seller_reducible_late,
               total_gmv * share / 100.0::DOUBLE AS seller_revenue_at_risk,
               worst_state,
               aov * CAST(ws_orders AS DOUBLE) AS state_revenue_at_risk,
               CAST(round_even(CAST(ws_late AS DOUBLE) * {p.state_late_cut}::DOUBLE, 0) AS BIGINT)
                 AS state_reducible_late,
               eligible_cohort_customers,
               CAST(round_even(CAST(eligible_cohort_customers AS DOUBLE) * {p.retention_lift}::DOUBLE
                               * avg_orders_per_customer, 0) AS BIGINT) AS incremental_orders
        FROM (
          SELECT CAST(round_even(CAST(r.clean_rows AS DOUBLE) * (100.0::DOUBLE - o.overall_otdr_pct)
                                 / 100.0::DOUBLE, 0) AS BIGINT) AS total_late_orders,
                 b.bottom_seller_breach_share_pct AS share, f.total_gmv, f.aov,
                 w.customer_state AS worst_state, w.total_orders AS ws_orders, w.late_orders AS ws_late,
                 e.eligible_cohort_customers, l.avg_orders_per_customer
          FROM (SELECT count(*) AS clean_rows FROM orders_clean) r, d_overall o, d_bottom b, d_financials f,
               (SELECT * FROM k_sla_state ORDER BY breach_rate_pct DESC, customer_state LIMIT 1) w,
               (SELECT CAST(coalesce(sum(cohort_customers), 0) AS BIGINT) AS eligible_cohort_customers
                FROM k_cohort WHERE month_number = 0) e,
               d_ltv l)"""
    csv_ingest = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS good_rows, CAST(0 AS BIGINT) AS bad_rows FROM m_{t}"
        for t in canon) + " UNION ALL SELECT 'geo', count(*), CAST(0 AS BIGINT) FROM m_regions"
    return {
        "ingest_raw_tables": ingest,
        "ingest_csv_exports": csv_ingest,
        "orders_clean": "SELECT * FROM orders_clean",
        "status_distribution": f"""
            SELECT order_status, count(*) AS cnt,
                   round(100.0::DOUBLE * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 2) AS pct
            FROM m_orders GROUP BY order_status""",
        "review_distribution": "SELECT review_score, count(*) AS cnt FROM m_reviews GROUP BY review_score",
        "schema_validation": "SELECT * FROM d_validation",
        "quality_gates": "SELECT * FROM d_gates",
        "kpi_otdr_monthly": "SELECT * FROM k_otdr",
        "kpi_lead_time_category": "SELECT * FROM k_lead_category",
        "lead_time_detail": "SELECT * FROM k_lead_detail",
        "kpi_seller_scorecard": "SELECT * FROM k_seller",
        "kpi_sla_breach_geo": "SELECT * FROM k_sla_geo",
        "kpi_sla_breach_state": "SELECT * FROM k_sla_state",
        "kpi_cohort_retention": "SELECT * FROM k_cohort",
        "kpi_volume_trend": "SELECT * FROM k_volume",
        "kpi_product_velocity": "SELECT * FROM k_velocity",
        "kpi_freight_efficiency": "SELECT * FROM k_freight",
        "freight_corridors": "SELECT * FROM d_corridors",
        "overall_otdr": "SELECT * FROM d_overall",
        "otdr_trend": "SELECT * FROM d_trend",
        "seller_bottom_decile": "SELECT * FROM d_bottom",
        "state_lead_breach_corr": "SELECT * FROM d_corr",
        "state_lead_breach_pvalue": "SELECT * FROM d_corr_p",
        "kpi_summary": "SELECT * FROM d_metrics_all",
        "retention_matrix": "SELECT * FROM d_matrix",
        "retention_summary": "SELECT * FROM d_retention",
        "customer_ltv_proxy": "SELECT * FROM d_ltv",
        "order_financials": "SELECT * FROM d_financials",
        "volume_wow_growth": "SELECT * FROM d_wow",
        "top_gmv_weeks": "SELECT * FROM d_top_weeks",
        "product_velocity_inventory": "SELECT * FROM d_velocity_inventory",
        "median_freight_cost": "SELECT * FROM d_median",
        "kpi_summary_metrics": "SELECT * FROM d_metrics",
        "export_tables": export,
        "otdr_rolling_ci": f"""
            SELECT *, otdr_pct - ci_half_width AS ci_lower, otdr_pct + ci_half_width AS ci_upper
            FROM ({ci_base})""",
        "lead_time_top10_distribution": f"""
            SELECT d.category_en, t.plot_order, count(*) AS orders, min(d.actual_lead_time_days) AS min_lead,
                   round(quantile_cont(d.actual_lead_time_days, 0.25), 6) AS q1_lead,
                   round(quantile_cont(d.actual_lead_time_days, 0.5), 6) AS median_lead,
                   round(quantile_cont(d.actual_lead_time_days, 0.75), 6) AS q3_lead,
                   max(d.actual_lead_time_days) AS max_lead
            FROM k_lead_detail d
            JOIN (SELECT category_en, row_number() OVER (ORDER BY median_lead_time, category_en) AS plot_order
                  FROM (SELECT * FROM k_lead_category ORDER BY total_orders DESC, category_en
                        LIMIT {p.top_categories})) t ON t.category_en = d.category_en
            GROUP BY d.category_en, t.plot_order""",
        "seller_scatter": """
            SELECT s.seller_id, s.seller_state, s.late_rate_pct, s.avg_review_score, s.total_orders,
                   greatest(30, least(500, s.total_orders)) AS marker_size, c.state_code, w.label
            FROM k_seller s
            LEFT JOIN (SELECT seller_state, dense_rank() OVER (ORDER BY seller_state) - 1 AS state_code
                       FROM (SELECT DISTINCT seller_state FROM k_seller WHERE seller_state IS NOT NULL)) c
              ON c.seller_state = s.seller_state
            LEFT JOIN (SELECT seller_id, substring(CAST(seller_id AS VARCHAR), 1, 6) AS label FROM k_seller
                       ORDER BY seller_composite_score, seller_id LIMIT 5) w ON w.seller_id = s.seller_id""",
        "state_breach_map_values": """
            SELECT r.region_code, s.breach_rate_pct
            FROM (SELECT DISTINCT region_code FROM m_regions) r
            LEFT JOIN k_sla_state s ON s.customer_state = r.region_code""",
        "freight_outlier_lanes": f"""
            SELECT seller_state, customer_state, category_en, shipments, avg_freight_cost, avg_lead_time,
                   late_rate_pct, index_score, greatest(30, least(400, shipments * 2)) AS marker_size,
                   CASE WHEN row_number() OVER (ORDER BY index_score DESC, seller_state, customer_state, category_en) <= 5
                        THEN seller_state || '->' || customer_state END AS label
            FROM (SELECT *, {_pr('avg_freight_cost')} + {_pr('late_rate_pct')} AS index_score FROM k_freight)""",
        "velocity_top20": """
            SELECT category_en, units_per_week FROM d_velocity_inventory WHERE category_en IS NOT NULL
            ORDER BY units_per_week DESC NULLS LAST, category_en LIMIT 20""",
        "p90_vs_benchmark": """
            SELECT t.category_en, t.p90_lead_time, b.category_median_p90,
                   t.p90_lead_time > b.category_median_p90 AS above_benchmark
            FROM (SELECT * FROM k_lead_category ORDER BY p90_lead_time DESC NULLS LAST, category_en LIMIT 20) t
            CROSS JOIN (SELECT round(quantile_cont(p90_lead_time, 0.5), 6) AS category_median_p90
                        FROM k_lead_category) b""",
        "seller_score_histogram": hist,
        "volume_weekly_combo": "SELECT purchase_week, total_gmv, orders FROM k_volume",
        "category_extremes": f"""
            SELECT * FROM ({_extremes('k_lead_category', 'p90_lead_time', 'category_en',
                                      'category_en, total_orders, p90_lead_time, late_rate_pct')})
            CROSS JOIN (SELECT count(*) FILTER (WHERE lead_time_std / nullif(avg_lead_time, 0) > 0.5)
                          AS high_variability_categories FROM k_lead_category)""",
        "seller_worst5": """
            SELECT seller_id, seller_state, total_orders, late_rate_pct, avg_review_score, seller_composite_score
            FROM k_seller ORDER BY seller_composite_score, seller_id LIMIT 5""",
        "state_extremes": _extremes("k_sla_state", "breach_rate_pct", "customer_state",
                                    "customer_state, total_orders, breach_rate_pct, avg_lead_time, "
                                    "avg_delay_when_late"),
        "corridor_cost_premium": """
            SELECT row_number() OVER (ORDER BY c.cost_late_index DESC, c.seller_state, c.customer_state)
                     AS corridor_rank,
                   c.seller_state, c.customer_state, c.shipments, c.avg_freight_cost, c.late_rate_pct,
                   c.avg_lead_time,
                   (c.avg_freight_cost / m.median_freight_cost - 1.0::DOUBLE) * 100.0::DOUBLE AS cost_premium_pct
            FROM (SELECT * FROM d_corridors ORDER BY cost_late_index DESC, seller_state, customer_state LIMIT 5) c
            CROSS JOIN d_median m""",
        "impact_sizing": impact,
        "view_kpi_cards": "SELECT * FROM d_cards",
        "view_filter_domains": f"""
            SELECT 'max_seller_orders' AS domain, CAST(NULL AS VARCHAR) AS value_text,
                   CAST(max(total_orders) AS DOUBLE) AS value_num FROM k_seller
            UNION ALL SELECT DISTINCT 'customer_state', customer_state, CAST(NULL AS DOUBLE) FROM k_sla_state
            UNION ALL SELECT DISTINCT 'category', category_en, CAST(NULL AS DOUBLE) FROM k_lead_category
                      WHERE category_en IS NOT NULL
            UNION ALL SELECT 'default_category', category_en, CAST(total_orders AS DOUBLE)
                      FROM (SELECT * FROM k_lead_category ORDER BY total_orders DESC, category_en
                            LIMIT {p.top_categories})""",
        "view_categories": f"""
            SELECT category_en, total_orders, avg_lead_time, p90_lead_time, late_rate_pct FROM k_lead_category
            WHERE category_en IN ({top_cat})""",
        "view_sellers": f"""
            SELECT seller_id, seller_state, total_orders, late_rate_pct, avg_review_score, seller_composite_score
            FROM k_seller WHERE total_orders >= {p.min_seller_orders}
            ORDER BY seller_composite_score, seller_id LIMIT 20""",
        "view_states": """
            SELECT customer_state, total_orders, breach_rate_pct, avg_lead_time, avg_delay_when_late
            FROM k_sla_state""",
        "view_corridors": """
            SELECT seller_state, customer_state, shipments, avg_freight_cost, late_rate_pct, avg_lead_time
            FROM d_corridors ORDER BY cost_late_index DESC, seller_state, customer_state LIMIT 20""",
        "view_velocity": """
            SELECT category_en, units_sold, units_per_week, avg_lead_time, stockout_risk
            FROM d_velocity_inventory ORDER BY units_per_week DESC NULLS LAST, category_en LIMIT 30""",
        "consistency_checks": "SELECT * FROM d_consistency",
    }


def all_ctes(p: Params = DEFAULT) -> list[tuple[str, str]]:
    return base_ctes(p) + kpi_ctes(p) + derived_ctes(p)


def statement(final: str, p: Params = DEFAULT) -> str:
    """Prefix ``final`` with only the CTEs it (transitively) references."""
    ctes = all_ctes(p)
    names = [n for n, _ in ctes]
    bodies = dict(ctes)
    needed: set[str] = set()

    def visit(text: str) -> None:
        for n in names:
            if n not in needed and _references(text, n):
                needed.add(n)
                visit(bodies[n])

    visit(final)
    if final.strip().upper().startswith("WITH"):
        final = f"SELECT * FROM ({final.strip()})"
    chosen = [(n, bodies[n]) for n in names if n in needed]
    if not chosen:
        return final.strip()
    return "WITH " + ",\n".join(f"{n} AS ({b.strip()})" for n, b in chosen) + "\n" + final.strip()


def _references(text: str, name: str) -> bool:
    import re
    return re.search(rf"\b{re.escape(name)}\b", text) is not None


def oracle_statements(p: Params = DEFAULT) -> dict[str, str]:
    return {key: statement(sql, p) for key, sql in _final(p).items()}
