"""DuckDB SQL for every registered mart query, written from the rules.

The statements are formulated on their own: fan-out joins appear as row
multiplicities (items per order times reviews per order; a test holds these
against the literal joins), the quintiles as arithmetic on the row number,
cohort periods as month differences, shares as integer arithmetic on cents.
Shared with the Spark side are only the table specs (names, types, limits)
and the fixed values marked below.  Two rules hold on both sides because the
original engine implies them and others differ:

* ROUND of averages and percentages is half away from zero on the exact ratio
  (``rr``);
* quintile ties are broken by ``customer_unique_id``, NULLs sort last.

Exact money (DECIMAL) is cast to DOUBLE in the final projection, as the Spark
queries do.
"""

from __future__ import annotations

from valuemarts.sources.spec import FOREIGN_KEYS, STAGING, decimal_limit


def rr(num: str, den: str, k: int) -> str:
    """ROUND(num/den, k), half away from zero, exact; NULL when den is 0/NULL."""
    s = 10 ** k
    return (f"(CAST(CASE WHEN ({num}) < 0 THEN -1 ELSE 1 END * "
            f"((2 * {s} * abs(CAST(({num}) AS HUGEINT)) + CAST(({den}) AS HUGEINT)) // "
            f"(2 * CAST(NULLIF(({den}), 0) AS HUGEINT))) AS DOUBLE) / {s}.0)")


def cents(x: str) -> str:
    return f"CAST(({x}) * 100 AS HUGEINT)"


# --------------------------------------------------------------------------
# Staging tables from the driver's tables (FIXTURES.md §2)
# --------------------------------------------------------------------------

DELIVERED_DATE = ("CASE WHEN o_orderstatus = 'F' AND o_orderkey % 97 <> 0 THEN "
                  "CAST(o_orderdate AS DATE) + CAST(4 + (o_orderkey * 7) % 31 AS INTEGER) END")

STATE = "substr({0}, 1, 1) || chr(CAST(97 + {1} AS INTEGER))"

LINEITEM_ORDER = ("l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, "
                  "l_discount, l_tax, l_returnflag, l_linestatus")


def _lineitem_order_clause() -> str:
    return ", ".join(f"{c.strip()} ASC NULLS FIRST" for c in LINEITEM_ORDER.split(","))


STAGING_CTES = [
    ("stg_customers", f"""
        SELECT 'o' || CAST(o.o_orderkey AS VARCHAR) AS customer_id,
               'c' || CAST(o.o_custkey AS VARCHAR) AS customer_unique_id,
               lpad(CAST(c.c_nationkey AS VARCHAR), 5, '0') AS customer_zip_code_prefix,
               c.c_mktsegment AS customer_city,
               {STATE.format('n.n_name', 'c.c_nationkey')} AS customer_state
        FROM orders o
        JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey"""),
    ("stg_orders", f"""
        SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS order_id,
               'o' || CAST(o_orderkey AS VARCHAR) AS customer_id,
               CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
                    WHEN 'P' THEN 'canceled' ELSE o_orderstatus END AS order_status,
               o_orderdate AS order_purchase_timestamp,
               o_orderdate AS order_approved_at,
               CAST(({DELIVERED_DATE}) - 1 AS TIMESTAMP) AS order_delivered_carrier_date,
               CAST({DELIVERED_DATE} AS TIMESTAMP) AS order_delivered_customer_date,
               CAST(CAST(o_orderdate AS DATE) + CAST(18 + o_orderkey % 11 AS INTEGER) AS TIMESTAMP)
                   AS order_estimated_delivery_date
        FROM orders"""),
    ("lineitem_first", f"""
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                         ORDER BY {_lineitem_order_clause()}) AS rn
            FROM lineitem) WHERE rn = 1"""),
    ("stg_order_items_raw", """
        SELECT 'o' || CAST(l_orderkey AS VARCHAR) AS order_id,
               l_linenumber AS order_item_id,
               'p' || CAST(l_partkey AS VARCHAR) AS product_id,
               's' || CAST(l_suppkey AS VARCHAR) AS seller_id,
               l_shipdate AS shipping_limit_date,
               CAST(l_extendedprice AS DECIMAL(10,2)) AS price,
               CAST(l_quantity AS DECIMAL(10,2)) AS freight_value
        FROM lineitem"""),
    ("stg_order_items", """
        SELECT 'o' || CAST(l_orderkey AS VARCHAR) AS order_id,
               l_linenumber AS order_item_id,
               'p' || CAST(l_partkey AS VARCHAR) AS product_id,
               's' || CAST(l_suppkey AS VARCHAR) AS seller_id,
               l_shipdate AS shipping_limit_date,
               CAST(l_extendedprice AS DECIMAL(10,2)) AS price,
               CAST(l_quantity AS DECIMAL(10,2)) AS freight_value
        FROM lineitem_first"""),
    ("stg_order_payments_raw", """
        SELECT 'o' || CAST(l_orderkey AS VARCHAR) AS order_id,
               l_linenumber AS payment_sequential,
               l_returnflag AS payment_type,
               1 AS payment_installments,
               CAST(l_extendedprice AS DECIMAL(10,2)) AS payment_value
        FROM lineitem"""),
    ("stg_order_payments", """
        SELECT 'o' || CAST(l_orderkey AS VARCHAR) AS order_id,
               l_linenumber AS payment_sequential,
               l_returnflag AS payment_type,
               1 AS payment_installments,
               CAST(l_extendedprice AS DECIMAL(10,2)) AS payment_value
        FROM lineitem_first"""),
    ("stg_order_reviews", """
        SELECT 'r' || CAST(event_id AS VARCHAR) AS review_id,
               'o' || CAST(CASE WHEN event_id % 10 = 9 THEN event_id - 1 ELSE event_id END AS VARCHAR)
                   AS order_id,
               CAST(1 + CAST(floor(value) AS INTEGER) % 5 AS SMALLINT) AS review_score,
               event_type AS review_comment_title,
               props AS review_comment_message,
               ts AS review_creation_date,
               ts AS review_answer_timestamp
        FROM events"""),
    ("stg_products", """
        SELECT 'p' || CAST(p_partkey AS VARCHAR) AS product_id,
               CASE WHEN p_partkey % 50 <> 0 THEN p_type || ' ' || p_brand END AS product_category_name,
               CAST(length(p_name) AS INTEGER) AS product_name_lenght,
               CAST(length(p_brand) AS INTEGER) AS product_description_lenght,
               CAST(p_size % 5 AS INTEGER) AS product_photos_qty,
               CAST(p_size AS INTEGER) AS product_weight_g,
               CAST(p_size AS INTEGER) AS product_length_cm,
               CAST(p_size % 7 AS INTEGER) AS product_height_cm,
               CAST(p_size % 11 AS INTEGER) AS product_width_cm
        FROM part WHERE p_partkey % 101 <> 0"""),
    ("stg_sellers", f"""
        SELECT 's' || CAST(s.s_suppkey AS VARCHAR) AS seller_id,
               lpad(CAST(s.s_nationkey AS VARCHAR), 5, '0') AS seller_zip_code_prefix,
               s.s_name AS seller_city,
               {STATE.format('n.n_name', 's.s_nationkey')} AS seller_state
        FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey"""),
    ("stg_geolocation", f"""
        SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS geolocation_zip_code_prefix,
               CAST(n_nationkey AS DECIMAL(10,6)) AS geolocation_lat,
               CAST(n_nationkey AS DECIMAL(10,6)) AS geolocation_lng,
               n_name AS geolocation_city,
               {STATE.format('n_name', 'n_nationkey')} AS geolocation_state
        FROM nation"""),
    ("stg_product_category_translation", """
        SELECT DISTINCT p_type || ' ' || p_brand AS product_category_name,
               lower(p_type || ' ' || p_brand) AS product_category_name_english
        FROM part WHERE p_type NOT LIKE 'PROMO%'"""),
]

# The staging tables with faults, for the quality checks.
NUMBER = "CAST(substr({0}, 2) AS BIGINT)"
FAULTY_CTES = [
    ("faulty_stg_customers", f"""
        SELECT * REPLACE (
            CASE WHEN {NUMBER.format('customer_id')} % 37 <> 0 THEN customer_city END AS customer_city,
            CASE WHEN {NUMBER.format('customer_id')} % 41 = 0 THEN 'too long' ELSE customer_state END AS customer_state)
        FROM stg_customers"""),
    ("faulty_stg_orders", f"""
        SELECT * REPLACE (CASE WHEN {NUMBER.format('order_id')} % 43 = 0 THEN 'x' || customer_id ELSE customer_id END AS customer_id)
        FROM stg_orders"""),
    ("faulty_stg_order_items", f"""
        SELECT * REPLACE (CASE WHEN {NUMBER.format('order_id')} % 47 <> 0 THEN price END AS price,
                          CASE WHEN {NUMBER.format('order_id')} % 53 = 0 THEN 's-none' ELSE seller_id END AS seller_id)
        FROM stg_order_items"""),
    ("faulty_stg_sellers", f"""
        SELECT * REPLACE (CASE WHEN {NUMBER.format('seller_id')} % 7 = 0 THEN '00000-00000' ELSE seller_zip_code_prefix END AS seller_zip_code_prefix)
        FROM stg_sellers"""),
]
FAULTY = {name.removeprefix("faulty_"): name for name, _ in FAULTY_CTES}

# --------------------------------------------------------------------------
# Marts
# --------------------------------------------------------------------------


def quintile(order: str) -> str:
    """Tile 1..5 of a row: the first n mod 5 tiles hold one row more than the rest."""
    pos = f"(row_number() OVER (ORDER BY {order} NULLS LAST, customer_unique_id) - 1)"
    n = "count(*) OVER ()"
    wide = f"(({n}) % 5) * (({n}) // 5 + 1)"
    return (f"CAST(1 + CASE WHEN {pos} < {wide} THEN {pos} // (({n}) // 5 + 1) "
            f"ELSE ({n}) % 5 + ({pos} - {wide}) // greatest(({n}) // 5, 1) END AS INTEGER)")


def per_row(value: str, weight: str = "copies") -> tuple[str, str]:
    """Sum and number of the non-NULL values over the fanned-out rows."""
    return f"sum({value} * {weight})", f"sum({weight}) FILTER ({value} IS NOT NULL)"


def mean(value: str, places: int, weight: str = "copies") -> str:
    total, number = per_row(value, weight)
    return rr(total, number, places)


LATE_SHARE = rr("100 * coalesce(sum(copies) FILTER (delivery_delay_days > 0), 0)", "sum(copies)", 2)
SCORE_MEAN = rr("sum(score_sum * items)", "sum(scores * items)", 2)

# The segment rules, first match wins, and the segments at risk.
SEGMENT_CASE = """CASE
                   WHEN r_score >= 4 AND f_score >= 4 THEN 'Champions'
                   WHEN r_score >= 3 AND f_score >= 3 THEN 'Loyal'
                   WHEN r_score >= 4 AND f_score <= 2 THEN 'Promising'
                   WHEN r_score = 3 AND f_score >= 2 THEN 'Needs Attention'
                   WHEN r_score <= 2 AND f_score >= 3 THEN 'At-Risk'
                   WHEN r_score = 2 AND f_score <= 2 THEN 'About to Sleep'
                   WHEN r_score = 1 THEN 'Lost'
                   ELSE 'Others'
               END"""
AT_RISK = "('At-Risk', 'Lost', 'About to Sleep')"

VIEW_CTES = [
    ("dim_customers", """
        SELECT customer_unique_id,
               list_aggregate(list(customer_city), 'max') AS customer_city,
               list_aggregate(list(customer_state), 'max') AS customer_state
        FROM stg_customers GROUP BY ALL"""),
    ("dim_products", """
        SELECT product_id,
               ifnull(ifnull((SELECT any_value(product_category_name_english) FROM stg_product_category_translation names
                              WHERE names.product_category_name = stg_products.product_category_name),
                             product_category_name), 'unknown') AS category_en,
               product_weight_g, product_photos_qty
        FROM stg_products"""),
    ("paid", """
        SELECT order_id, sum(payment_value) AS total_payment_value FROM stg_order_payments GROUP BY ALL"""),
    ("fact_orders", """
        SELECT order_id, customer_unique_id, order_status, order_purchase_timestamp, order_approved_at,
               order_delivered_customer_date, order_estimated_delivery_date,
               CAST(date_diff('day', order_estimated_delivery_date, order_delivered_customer_date) AS INTEGER)
                   AS delivery_delay_days,
               total_payment_value,
               if(order_status = 'delivered', total_payment_value, NULL) AS revenue
        FROM stg_customers INNER JOIN stg_orders USING (customer_id) LEFT JOIN paid USING (order_id)"""),
    ("delivered", "SELECT * FROM fact_orders WHERE order_status = 'delivered'"),
    ("fact_order_items", """
        SELECT order_id, order_item_id, product_id, seller_id, category_en, price, freight_value,
               freight_value + price AS item_total
        FROM dim_products RIGHT JOIN stg_order_items USING (product_id)"""),
    ("fact_reviews", """
        SELECT review_id, order_id, customer_unique_id, CAST(review_score AS INTEGER) AS review_score,
               review_creation_date, order_delivered_customer_date, delivery_delay_days
        FROM fact_orders INNER JOIN stg_order_reviews USING (order_id)"""),
    ("rfm_raw", """
        SELECT customer_unique_id,
               CAST(date_diff('day', max(order_purchase_timestamp),
                              (SELECT max(order_purchase_timestamp) FROM delivered)) AS INTEGER) AS recency_days,
               count(order_id) AS frequency, sum(revenue) AS monetary
        FROM delivered GROUP BY ALL"""),
    ("rfm_scores", f"""
        SELECT customer_unique_id, recency_days, frequency, round(monetary, 2) AS monetary,
               6 - {quintile('recency_days')} AS r_score,
               {quintile('frequency')} AS f_score,
               {quintile('monetary')} AS m_score
        FROM rfm_raw"""),
    ("rfm_segments", f"""
        SELECT *, list_sum([r_score, f_score, m_score])::INTEGER AS rfm_total,
               {SEGMENT_CASE} AS rfm_segment
        FROM rfm_scores"""),
    ("rfm_segment_summary", f"""
        SELECT rfm_segment, count(customer_unique_id) AS customer_count,
               CAST(round(sum(monetary), 2) AS DOUBLE) AS total_revenue,
               {rr(cents('sum(monetary)'), '100 * count(monetary)', 2)} AS avg_revenue_per_customer,
               {rr('sum(recency_days)', 'count(recency_days)', 1)} AS avg_recency_days,
               {rr('sum(frequency)', 'count(frequency)', 2)} AS avg_frequency
        FROM rfm_segments GROUP BY ALL"""),
    ("first_orders", """
        SELECT customer_unique_id, min(order_purchase_timestamp) AS first_order_date FROM delivered GROUP BY ALL"""),
    ("cohort_base", """
        SELECT customer_unique_id, make_date(year(first_order_date), month(first_order_date), 1) AS cohort_month,
               first_order_date
        FROM first_orders"""),
    ("customer_order_months", """
        SELECT customer_unique_id, make_date(year(order_purchase_timestamp), month(order_purchase_timestamp), 1) AS order_month
        FROM delivered GROUP BY ALL"""),
    ("cohort_retention_grid", """
        SELECT cohort_month, CAST(date_diff('month', cohort_month, order_month) AS INTEGER) AS period_number,
               count(customer_unique_id) AS retained_customers
        FROM customer_order_months INNER JOIN cohort_base USING (customer_unique_id)
        WHERE date_diff('month', cohort_month, order_month) >= 0 GROUP BY ALL"""),
    ("cohort_sizes", """
        SELECT cohort_month, count(*) AS cohort_size FROM cohort_base GROUP BY ALL"""),
    ("cohort_retention_rates", f"""
        SELECT format('{{:04d}}-{{:02d}}', year(cohort_month), month(cohort_month)) AS cohort_month,
               period_number, retained_customers, cohort_size,
               {rr('retained_customers * 100', 'cohort_size', 2)} AS retention_pct
        FROM cohort_sizes INNER JOIN cohort_retention_grid USING (cohort_month)"""),
    ("cohort_avg_retention", f"""
        SELECT period_number,
               {rr('sum(CAST(round(100 * retention_pct) AS HUGEINT))', '100 * count(retention_pct)', 2)} AS avg_retention_pct,
               sum(retained_customers)::BIGINT AS total_retained, sum(cohort_size)::BIGINT AS total_cohort_size
        FROM cohort_retention_rates GROUP BY ALL"""),
    ("segment_money", """
        SELECT rfm_segment, count(*) AS customer_count, sum(monetary) AS money FROM rfm_segments GROUP BY ALL"""),
    ("revenue_by_segment", f"""
        SELECT rfm_segment, customer_count, CAST(round(money, 2) AS DOUBLE) AS segment_revenue,
               {rr(cents('money') + ' * 100', cents('(SELECT sum(money) FROM segment_money)'), 2)} AS revenue_share_pct,
               CAST(rfm_segment IN {AT_RISK} AS INTEGER) AS is_at_risk
        FROM segment_money"""),
    ("kpi_revenue_at_risk", """
        SELECT CAST(sum(segment_revenue::DECIMAL(38,2)) FILTER (is_at_risk = 1) AS DOUBLE) AS revenue_at_risk,
               CAST(sum(revenue_share_pct::DECIMAL(38,2)) FILTER (is_at_risk = 1) AS DOUBLE) AS revenue_at_risk_pct
        FROM revenue_by_segment"""),
    # reviews of an order: how many rows the order becomes in a left join, and the sums of their scores
    ("reviewed", """
        SELECT order_id, count(*) AS reviews, sum(review_score) AS score_sum, count(review_score) AS scores
        FROM stg_order_reviews GROUP BY ALL"""),
    ("delivered_reviewed", """
        SELECT * EXCLUDE (reviews, score_sum, scores), greatest(ifnull(reviews, 0), 1) AS reviews,
               ifnull(score_sum, 0) AS score_sum, ifnull(scores, 0) AS scores
        FROM delivered LEFT JOIN reviewed USING (order_id)"""),
    ("delivery_vs_review", f"""
        SELECT review_score, sum(copies)::BIGINT AS order_count,
               {mean('delivery_delay_days', 2)} AS avg_delivery_delay_days,
               min(delivery_delay_days)::INTEGER AS min_delay_days, max(delivery_delay_days)::INTEGER AS max_delay_days,
               {LATE_SHARE} AS late_delivery_pct
        FROM (SELECT order_id, review_score, delivery_delay_days, count(*) AS copies FROM fact_reviews
              WHERE delivery_delay_days IS NOT NULL GROUP BY ALL)
        GROUP BY ALL"""),
    ("state_items", """
        SELECT order_id, seller_state, count(*) AS items
        FROM stg_sellers INNER JOIN stg_order_items USING (seller_id) GROUP BY ALL"""),
    ("delivery_delay_by_seller_state", f"""
        SELECT seller_state, count(*) AS delivered_order_count,
               {mean('delivery_delay_days', 2)} AS avg_delay_days, {LATE_SHARE} AS late_pct,
               {SCORE_MEAN} AS avg_review_score
        FROM (SELECT *, items * reviews AS copies FROM state_items INNER JOIN delivered_reviewed USING (order_id)
              WHERE delivery_delay_days IS NOT NULL)
        GROUP BY ALL"""),
    ("segment_delivery_experience", f"""
        SELECT rfm_segment, count(DISTINCT customer_unique_id) AS customer_count,
               CAST(round(sum(monetary * copies), 2) AS DOUBLE) AS segment_revenue,
               {mean('delivery_delay_days', 2)} AS avg_delivery_delay_days,
               {SCORE_MEAN} AS avg_review_score, {LATE_SHARE} AS late_delivery_pct
        FROM (SELECT *, reviews AS copies, 1 AS items FROM delivered_reviewed INNER JOIN rfm_segments USING (customer_unique_id))
        GROUP BY ALL"""),
    ("category_items", """
        SELECT order_id, category_en, count(*) AS items FROM fact_order_items GROUP BY ALL"""),
    ("category_revenue_delivery", f"""
        SELECT category_en, count(*) AS order_count,
               CAST(round(sum(revenue * copies), 2) AS DOUBLE) AS total_revenue,
               {mean('delivery_delay_days', 2)} AS avg_delay_days, {SCORE_MEAN} AS avg_review_score
        FROM (SELECT *, items * reviews AS copies FROM category_items INNER JOIN delivered_reviewed USING (order_id))
        GROUP BY ALL"""),
    ("totals", """
        SELECT count(order_id) AS total_orders, CAST(round(sum(revenue), 0) AS DOUBLE) AS total_revenue,
               (SELECT count(*) FROM first_orders) AS total_customers
        FROM delivered"""),
    ("repeat_rate", f"""
        SELECT {rr('100 * count(*) FILTER (frequency >= 2)', 'count(*)', 1)} AS repeat_pct FROM rfm_raw"""),
    ("ranked_categories", """
        SELECT *, row_number() OVER (ORDER BY total_revenue DESC NULLS FIRST, category_en NULLS FIRST) AS position
        FROM category_revenue_delivery"""),
    ("top_categories", "SELECT * EXCLUDE (position) FROM ranked_categories WHERE position <= 15"),
    ("ranked_states", """
        SELECT *, row_number() OVER (ORDER BY avg_delay_days DESC NULLS FIRST, seller_state NULLS FIRST) AS position
        FROM delivery_delay_by_seller_state"""),
    ("top_seller_states", "SELECT * EXCLUDE (position) FROM ranked_states WHERE position <= 20"),
]

PREFIX = "WITH " + ",\n".join(f"{name} AS ({body}\n)" for name, body in STAGING_CTES + FAULTY_CTES + VIEW_CTES)


def q(select: str) -> str:
    return PREFIX + "\n" + select


def _money_double(cols: list[str], money: set[str]) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in money else c for c in cols)


def _staging_select(table: str, source: str | None = None) -> str:
    spec = STAGING[table]
    cols = []
    for c in spec.columns:
        t = c.dtype.simpleString()
        if t.startswith("decimal"):
            cols.append(f"CAST({c.name} AS DOUBLE) AS {c.name}")
        elif t == "smallint":
            cols.append(f"CAST({c.name} AS INTEGER) AS {c.name}")
        else:
            cols.append(c.name)
    return f"SELECT {', '.join(cols)} FROM {source or table}"


def _one_place(x: str, signed: bool = False) -> str:
    tenths = f"CAST({rr(f'CAST(round(CAST({x} AS DECIMAL(38,2)) * 100) AS HUGEINT)', '10', 0)} AS BIGINT)"
    sign = f"CASE WHEN {tenths} < 0 THEN '-' ELSE '{'+' if signed else ''}' END"
    return (f"({sign} || CAST(abs({tenths}) // 10 AS VARCHAR) || '.' || "
            f"CAST(abs({tenths}) % 10 AS VARCHAR))")


def _whole(x: str) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,2)), 0) AS BIGINT)"


def _dq_null_counts(faulty: dict[str, str]) -> str:
    parts = []
    for name, spec in STAGING.items():
        for c in spec.not_null:
            parts.append(f"SELECT '{name}' AS table_name, '{c}' AS column_name, "
                         f"CAST(COALESCE(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) "
                         f"AS null_count FROM {faulty.get(name, name)}")
    return "\nUNION ALL\n".join(parts)


def _dq_domain(faulty: dict[str, str]) -> str:
    parts = []
    for name, spec in STAGING.items():
        for c in spec.columns:
            if c.max_length is not None:
                parts.append(f"SELECT '{name}' AS table_name, '{c.name}' AS column_name, "
                             f"'length>{c.max_length}' AS rule, "
                             f"CAST(COALESCE(SUM(CASE WHEN length({c.name}) > {c.max_length} THEN 1 "
                             f"ELSE 0 END), 0) AS BIGINT) AS violations FROM {faulty.get(name, name)}")
            limit = decimal_limit(c.dtype)
            if limit is not None:
                parts.append(f"SELECT '{name}' AS table_name, '{c.name}' AS column_name, "
                             f"'abs>={limit:g}' AS rule, "
                             f"CAST(COALESCE(SUM(CASE WHEN abs({c.name}) >= {limit!r} THEN 1 "
                             f"ELSE 0 END), 0) AS BIGINT) AS violations FROM {faulty.get(name, name)}")
    return "\nUNION ALL\n".join(parts)


def _dq_pk(raw: dict[str, str]) -> str:
    parts = []
    for name, spec in STAGING.items():
        if not spec.pk:
            continue
        keys = ", ".join(spec.pk)
        parts.append(f"SELECT '{name}' AS table_name, CAST(COUNT(*) AS BIGINT) AS duplicate_keys, "
                     f"CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_rows FROM "
                     f"(SELECT {keys}, COUNT(*) AS n FROM {raw.get(name, name)} GROUP BY {keys}) "
                     f"WHERE n > 1")
    return "\nUNION ALL\n".join(parts)


def _dq_orphans(faulty: dict[str, str]) -> str:
    parts = []
    for child, ccol, parent, pcol in FOREIGN_KEYS:
        parts.append(f"SELECT '{child}.{ccol} -> {parent}.{pcol}' AS edge, "
                     f"CAST(COUNT(*) AS BIGINT) AS orphan_rows, "
                     f"CAST(COUNT(DISTINCT {ccol}) AS BIGINT) AS orphan_keys "
                     f"FROM {faulty.get(child, child)} x WHERE NOT EXISTS "
                     f"(SELECT 1 FROM {faulty.get(parent, parent)} p WHERE p.{pcol} = x.{ccol})")
    return "\nUNION ALL\n".join(parts)


def _ingest_report() -> str:
    """The loader's report: geolocation has no file; item and payment keys repeat."""
    parts = []
    for name, spec in STAGING.items():
        if name == "stg_geolocation":
            parts.append(f"SELECT '{name}' AS table_name, 'skipped' AS status, CAST(NULL AS BIGINT) AS rows_in, "
                         "CAST(NULL AS BIGINT) AS rows_dropped, CAST(NULL AS BIGINT) AS rows_out")
            continue
        src = f"{name}_raw" if name in ("stg_order_items", "stg_order_payments") else name
        out = f"COUNT(DISTINCT ({', '.join(spec.pk)}))"
        parts.append(f"SELECT '{name}' AS table_name, 'loaded' AS status, "
                     f"CAST(COUNT(*) AS BIGINT) AS rows_in, "
                     f"CAST(COUNT(*) - {out} AS BIGINT) AS rows_dropped, "
                     f"CAST({out} AS BIGINT) AS rows_out FROM {src}")
    return "\nUNION ALL\n".join(parts)


def _reload_report() -> str:
    """Three loads: without geolocation and reviews; every second order and the
    products; one that fails."""
    parts = []
    for name, spec in STAGING.items():
        src = f"{name}_raw" if name in ("stg_order_items", "stg_order_payments") else name
        out = f"COUNT(DISTINCT ({', '.join(spec.pk)}))" if spec.pk else "COUNT(*)"
        for load, absent in ((1, name in ("stg_geolocation", "stg_order_reviews")), (2, name not in ("stg_orders", "stg_products"))):
            head = f"SELECT {load} AS load, '{name}' AS table_name, "
            if absent:
                parts.append(head + "'skipped' AS status, CAST(NULL AS BIGINT) AS rows_in, CAST(NULL AS BIGINT) AS rows_dropped, CAST(NULL AS BIGINT) AS rows_out")
                continue
            where = " WHERE CAST(substr(order_id, 2) AS BIGINT) % 2 = 0" if load == 2 and name == "stg_orders" else ""
            parts.append(head + f"'loaded' AS status, CAST(COUNT(*) AS BIGINT) AS rows_in, CAST(COUNT(*) - {out} AS BIGINT) AS rows_dropped, "
                         f"CAST({out} AS BIGINT) AS rows_out FROM {src}{where}")
    parts.append("SELECT 3 AS load, 'all' AS table_name, 'failed' AS status, CAST(NULL AS BIGINT) AS rows_in, CAST(NULL AS BIGINT) AS rows_dropped, CAST(NULL AS BIGINT) AS rows_out")
    return "\nUNION ALL\n".join(parts)


def _reload_rows() -> str:
    parts = []
    for name in STAGING:
        first = "0" if name in ("stg_geolocation", "stg_order_reviews") else f"(SELECT COUNT(*) FROM {name})"
        now = "(SELECT COUNT(*) FROM stg_orders WHERE CAST(substr(order_id, 2) AS BIGINT) % 2 = 0)" if name == "stg_orders" else first
        parts.append(f"SELECT '{name}' AS table_name, CAST({first} AS BIGINT) AS rows_first, CAST({now} AS BIGINT) AS rows_now")
    return "\nUNION ALL\n".join(parts)


RELOAD_ORDERS = """
SELECT order_status, CAST(COUNT(*) AS BIGINT) AS items, CAST(COUNT(DISTINCT order_id) AS BIGINT) AS orders
FROM stg_order_items JOIN stg_orders USING (order_id) JOIN stg_sellers USING (seller_id)
WHERE CAST(substr(order_id, 2) AS BIGINT) % 2 = 0 GROUP BY order_status"""


SEGMENT_FILTER = ("Champions", "Loyal", "At-Risk")
IN_FILTER = "rfm_segment IN (" + ", ".join(f"'{s}'" for s in SEGMENT_FILTER) + ")"


def _percent(x: str) -> str:
    return f"{_one_place(x)} || '%'"


def _position(view: str, order: str, where: str = "TRUE", limit: int | None = None) -> str:
    """A mart with each row's place in its export."""
    rows = f"SELECT *, row_number() OVER (ORDER BY {order}) AS position FROM {view} WHERE {where}"
    return q(f"SELECT * FROM ({rows}) WHERE position <= {limit or 1 << 60}")


def selects(faulty: dict[str, str] = FAULTY) -> dict[str, str]:
    """Final SELECT of every key; they read the CTEs of ``PREFIX``.  The
    column and orphan checks read the tables named in ``faulty``."""
    money_items = {"price", "freight_value", "item_total"}
    sqls = {
        # staging
        "stg_customers": q(_staging_select("stg_customers")),
        "stg_orders": q(_staging_select("stg_orders")),
        "stg_timestamps_coerced": q(_staging_select("stg_orders", f"""(SELECT * REPLACE (
            CASE WHEN {NUMBER.format('order_id')} % 13 <> 0 THEN order_approved_at END AS order_approved_at) FROM stg_orders)""")),
        "stg_order_items": q(_staging_select("stg_order_items")),
        "stg_order_payments": q(_staging_select("stg_order_payments")),
        "stg_order_reviews": q(_staging_select("stg_order_reviews")),
        "stg_products": q(_staging_select("stg_products")),
        "stg_sellers": q(_staging_select("stg_sellers")),
        "stg_geolocation": q(_staging_select("stg_geolocation")),
        "stg_category_translation": q(_staging_select("stg_product_category_translation")),
        "dedup_order_items": q(
            "SELECT l_orderkey, l_linenumber, " + LINEITEM_ORDER + " FROM lineitem_first"),
        "ingest_report": q(_ingest_report()),
        "reload_report": q(_reload_report()),
        "reload_rows": q(_reload_rows()),
        "reload_orders": q(RELOAD_ORDERS),
        "dq_pk_violations": q(_dq_pk({"stg_order_items": "stg_order_items_raw",
                                      "stg_order_payments": "stg_order_payments_raw"})),
        "dq_null_counts": q(_dq_null_counts(faulty)),
        "dq_domain_violations": q(_dq_domain(faulty)),
        "dq_orphans": q(_dq_orphans(faulty)),
        # conformed
        "dim_customers": q("SELECT * FROM dim_customers"),
        "dim_products": q("SELECT * FROM dim_products"),
        "fact_orders": q("SELECT order_id, customer_unique_id, order_status, order_purchase_timestamp, "
                         "order_approved_at, order_delivered_customer_date, "
                         "order_estimated_delivery_date, delivery_delay_days, "
                         "CAST(total_payment_value AS DOUBLE) AS total_payment_value, "
                         "CAST(revenue AS DOUBLE) AS revenue FROM fact_orders"),
        "fact_order_items": q("SELECT " + _money_double(
            ["order_id", "order_item_id", "product_id", "seller_id", "category_en", "price",
             "freight_value", "item_total"], money_items) + " FROM fact_order_items"),
        "fact_reviews": q("SELECT * FROM fact_reviews"),
        # RFM
        "rfm_raw": q("SELECT customer_unique_id, recency_days, frequency, "
                     "CAST(monetary AS DOUBLE) AS monetary FROM rfm_raw"),
        "rfm_scores": q("SELECT customer_unique_id, recency_days, frequency, "
                        "CAST(monetary AS DOUBLE) AS monetary, r_score, f_score, m_score FROM rfm_scores"),
        "rfm_segments": q("SELECT customer_unique_id, recency_days, frequency, "
                          "CAST(monetary AS DOUBLE) AS monetary, r_score, f_score, m_score, rfm_total, "
                          "rfm_segment FROM rfm_segments"),
        "rfm_segment_summary": q("SELECT * FROM rfm_segment_summary"),
        "repeat_rate": q("SELECT * FROM repeat_rate"),
        "rfm_scatter": q("SELECT customer_unique_id, recency_days, CAST(monetary AS DOUBLE) AS monetary, "
                         "frequency, rfm_segment FROM rfm_segments "
                         "ORDER BY md5(customer_unique_id), customer_unique_id LIMIT 6000"),
        "rfm_scatter_500": q("SELECT customer_unique_id, recency_days, CAST(monetary AS DOUBLE) AS monetary, "
                             "frequency, rfm_segment FROM (SELECT *, row_number() OVER (ORDER BY md5(customer_unique_id), "
                             "customer_unique_id) AS position FROM rfm_segments) WHERE position <= 500"),
        "segment_experience_filter": q("SELECT * FROM segment_delivery_experience WHERE " + IN_FILTER),
        "scatter_filter": q("SELECT customer_unique_id, recency_days, CAST(monetary AS DOUBLE) AS monetary, frequency, rfm_segment "
                            "FROM (SELECT *, row_number() OVER (ORDER BY md5(customer_unique_id), customer_unique_id) AS position "
                            "FROM rfm_segments) WHERE position <= 6000 AND " + IN_FILTER),
        "segment_filter": q("SELECT * FROM rfm_segment_summary WHERE rfm_segment IN ("
                            + ", ".join(f"'{s}'" for s in SEGMENT_FILTER) + ")"),
        # cohorts
        "cohort_base": q("SELECT * FROM cohort_base"),
        "customer_order_months": q("SELECT * FROM customer_order_months"),
        "cohort_retention_grid": q("SELECT * FROM cohort_retention_grid"),
        "cohort_sizes": q("SELECT * FROM cohort_sizes"),
        "cohort_retention_rates": q("SELECT * FROM cohort_retention_rates"),
        "cohort_avg_retention": q("SELECT * FROM cohort_avg_retention"),
        "cohort_rates_6": q("SELECT * FROM cohort_retention_rates WHERE period_number <= 6"),
        "cohort_avg_6": q("SELECT * FROM cohort_avg_retention WHERE period_number <= 6"),
        "cohort_matrix": q("SELECT cohort_month, " + ", ".join(
            f"COALESCE(MAX(CASE WHEN period_number = {p} THEN retention_pct END), 0.0) AS period_{p}"
            for p in range(7)) + " FROM cohort_retention_rates WHERE period_number <= 6 "
            "GROUP BY cohort_month"),
        # revenue at risk / delivery
        "revenue_by_segment": q("SELECT * FROM revenue_by_segment"),
        "kpi_revenue_at_risk": q("SELECT * FROM kpi_revenue_at_risk"),
        "delivery_vs_review": q("SELECT * FROM delivery_vs_review"),
        "delivery_delay_by_seller_state": q("SELECT * FROM delivery_delay_by_seller_state"),
        "segment_delivery_experience": q("SELECT * FROM segment_delivery_experience"),
        "category_revenue_delivery": q("SELECT * FROM category_revenue_delivery"),
        "late_rate_ratio": q(
            "SELECT late_pct_low, late_pct_high, "
            + rr("CAST(round(late_pct_low * 100) AS HUGEINT)",
                 "CAST(round(late_pct_high * 100) AS HUGEINT)", 2)
            + " AS late_rate_ratio FROM (SELECT "
            "MAX(CASE WHEN review_score = 1 THEN late_delivery_pct END) AS late_pct_low, "
            "MAX(CASE WHEN review_score = 5 THEN late_delivery_pct END) AS late_pct_high "
            "FROM delivery_vs_review)"),
        # presentation
        "totals": q("SELECT * FROM totals"),
        "top_categories": q("SELECT * FROM top_categories"),
        "top_seller_states": q("SELECT * FROM top_seller_states"),
        "kpi_row": q("SELECT t.total_orders, t.total_revenue, t.total_customers, "
                     "k.revenue_at_risk_pct, k.revenue_at_risk, r.repeat_pct "
                     "FROM totals t CROSS JOIN kpi_revenue_at_risk k CROSS JOIN repeat_rate r"),
        "safe_vs_risk": q("SELECT 'Safe Revenue' AS label, CAST(CAST(t.total_revenue AS DECIMAL(38,2)) "
                          "- CAST(k.revenue_at_risk AS DECIMAL(38,2)) AS DOUBLE) AS revenue "
                          "FROM totals t CROSS JOIN kpi_revenue_at_risk k "
                          "UNION ALL SELECT 'Revenue at Risk', revenue_at_risk FROM kpi_revenue_at_risk"),
        "delivery_bands": q("SELECT review_score, avg_delivery_delay_days, late_delivery_pct, "
                            "CASE WHEN avg_delivery_delay_days > 0 THEN 'late' ELSE 'early' END AS delay_band, "
                            "CASE WHEN late_delivery_pct > 10 THEN 'high' WHEN late_delivery_pct > 5 "
                            "THEN 'medium' ELSE 'low' END AS late_band FROM delivery_vs_review"),
        "state_bands": q("SELECT seller_state, avg_delay_days, avg_review_score, "
                         "CASE WHEN avg_delay_days > 0 THEN 'late' WHEN avg_delay_days > -5 THEN 'near' "
                         "ELSE 'early' END AS delay_band FROM top_seller_states"),
        "retention_bands": q("SELECT period_number, avg_retention_pct, "
                             "CASE WHEN period_number = 0 THEN 'acquisition' "
                             "WHEN avg_retention_pct > 3 THEN 'above_3pct' ELSE 'at_most_3pct' END "
                             "AS retention_band FROM cohort_avg_retention WHERE period_number <= 6"),
        "category_share": q("SELECT category_en, total_revenue, "
                            + rr(f"{cents('CAST(total_revenue AS DECIMAL(38,2))')} * 100",
                                 f"SUM({cents('CAST(total_revenue AS DECIMAL(38,2))')}) OVER ()", 2)
                            + " AS share_pct FROM ranked_categories WHERE position <= 10"),
        "segment_display_table": q(
            'SELECT rfm_segment AS "Segment", customer_count AS "Customers", '
            'total_revenue AS "Revenue (R$)", avg_revenue_per_customer AS "Avg Revenue", '
            'avg_recency_days AS "Avg Recency (days)", avg_frequency AS "Avg Frequency" '
            "FROM rfm_segment_summary"),
        "segment_labels": q(
            "SELECT rfm_segment, format('{:,}', CAST(customer_count AS BIGINT)) AS customers_label, "
            f"'R$ ' || format('{{:,}}', {_whole('total_revenue')}) AS revenue_label, "
            f"'R$ ' || format('{{:,}}', {_whole('avg_revenue_per_customer')}) AS avg_revenue_label "
            "FROM rfm_segment_summary"),
        "delivery_labels": q(
            f"SELECT review_score, {_one_place('avg_delivery_delay_days', True)} || 'd' AS delay_label, "
            f"{_one_place('late_delivery_pct')} || '%' AS late_label FROM delivery_vs_review"),
        "kpi_labels": q(
            "SELECT format('{:,}', total_orders) AS orders_label, "
            "'R$ ' || format('{:,}', CAST(trunc(total_revenue) AS BIGINT)) AS revenue_label, "
            "format('{:,}', total_customers) AS customers_label, "
            f"{_percent('revenue_at_risk_pct')} AS at_risk_pct_label, "
            f"'R$ ' || format('{{:,}}', {_whole('revenue_at_risk')}) AS at_risk_label, {_percent('repeat_pct')} AS repeat_label "
            "FROM totals, kpi_revenue_at_risk, repeat_rate"),
        "state_labels": q("SELECT seller_state, '★ ' || CASE WHEN avg_review_score IS NULL THEN 'nan' "
                          "ELSE printf('%.2f', avg_review_score) END AS score_label FROM top_seller_states"),
        "retention_labels": q(f"SELECT period_number, {_percent('avg_retention_pct')} AS retention_label "
                              "FROM cohort_avg_retention WHERE period_number <= 6"),
        # exports, read back, with each row's position
        "export_rfm_segment_summary": _position("rfm_segment_summary", "total_revenue DESC NULLS FIRST, rfm_segment"),
        "export_delivery_vs_review": _position("delivery_vs_review", "review_score NULLS FIRST"),
        "export_segment_delivery_experience": _position("segment_delivery_experience", "segment_revenue DESC NULLS FIRST, rfm_segment"),
        "export_category_revenue_delivery": _position(
            "category_revenue_delivery", "total_revenue DESC NULLS FIRST, category_en NULLS FIRST", limit=15),
        "export_delivery_delay_by_seller_state": _position(
            "delivery_delay_by_seller_state", "avg_delay_days DESC NULLS FIRST, seller_state NULLS FIRST", limit=20),
        "export_cohort_retention_rates": _position("cohort_retention_rates", "cohort_month, period_number", "period_number <= 6"),
        "export_cohort_avg_retention": _position("cohort_avg_retention", "period_number", "period_number <= 6"),
        "cohort_labels": q(
            "SELECT cohort_month, period_number, 'Month +' || CAST(period_number AS VARCHAR) AS period_label, "
            f"CASE WHEN retention_pct > 0 THEN {_one_place('retention_pct')} || '%' ELSE '' END AS cell_label "
            "FROM cohort_retention_rates WHERE period_number <= 6"),
    }
    return sqls


# Keys whose SELECT reads the driver's raw tables, not only staging and views.
RAW_TABLE_KEYS = {"dedup_order_items", "ingest_report", "reload_report", "reload_rows", "reload_orders", "dq_pk_violations"}


def _unwrap(sql: str) -> str:
    return sql[len(PREFIX) + 1:] if sql.startswith(PREFIX) else sql


def oracle_sql() -> dict[str, str]:
    return dict(selects())


def over_staging(key: str) -> str:
    """The key's SQL over already-registered staging tables (for hand-made rows)."""
    body = _unwrap(selects(faulty={})[key])
    return "WITH " + ",\n".join(f"{n} AS ({b}\n)" for n, b in VIEW_CTES) + "\n" + body
