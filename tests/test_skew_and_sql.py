"""Hot keys (a third of the rows on one key) and the SQL view surface."""

from datetime import datetime as dt, timedelta
from decimal import Decimal as D

import duckdb
import pytest

import __spark_entry__ as entry
from oracles.duckdb_sql import over_staging
from valuemarts.operators.dedup import keep_first
from valuemarts.plans.marts import Marts
from valuemarts.sources.spec import STAGING


def hot_staging(frames):
    customers, orders, items, pays, reviews = [], [], [], [], []
    base = dt(2017, 1, 1, 8)
    n_orders = 300
    for i in range(n_orders):
        cid, oid = f"k{i}", f"o{i}"
        uid = "u_hot" if i % 3 == 0 else f"u{i % 40}"          # a third of the orders
        customers.append((cid, uid, "01000", "c", "SP"))
        ts = base + timedelta(days=(i * 7) % 500)
        status = "delivered" if i % 10 else "shipped"
        delivered = ts + timedelta(days=5 + i % 9) if i % 13 else None
        orders.append((oid, cid, status, ts, ts, None, delivered, ts + timedelta(days=9)))
        pays.append((oid, 1, "card", 1, D(f"{10 + i % 17}.{i % 100:02d}")))
        items.append((oid, 1, f"p{i % 7}", f"s{i % 3}", None, D("5.00"), D("1.00")))
        reviews.append((f"r{i}", oid, 1 + i % 5, None, None, ts, None))
    # one order with a third of all items and 20 reviews
    for j in range(2, 2 + n_orders // 2):
        items.append(("o1", j, "p_hot" if j % 2 else "p1", "s1", None, D("2.50"), D("0.50")))
    for j in range(20):
        reviews.append((f"rh{j}", "o1", 1 + j % 5, None, None, base, None))
    products = [(f"p{i}", "cat_a" if i % 2 else "cat_b", None, None, 1, 1, None, None, None)
                for i in range(7)] + [("p_hot", "cat_hot", None, None, 1, 1, None, None, None)]
    sellers = [(f"s{i}", "0", "c", f"ST{i}") for i in range(3)]
    return frames(stg_customers=customers, stg_orders=orders, stg_order_items=items,
                  stg_order_payments=pays, stg_order_reviews=reviews, stg_products=products,
                  stg_sellers=sellers, stg_product_category_translation=[("cat_a", "A")])


def _bag(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(round(float(r[i]), 9) if isinstance(r[i], (float, D)) else r[i]
                         for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("key", ["rfm_scores", "rfm_segment_summary", "segment_delivery_experience",
                                 "category_revenue_delivery", "delivery_delay_by_seller_state",
                                 "cohort_avg_retention", "totals", "fact_order_items",
                                 "delivery_vs_review"])
def test_hot_keys_match_reference_sql(frames, key):
    staging = hot_staging(frames)
    m = Marts(staging, ntile_options={"rank_rows": 5})
    sdf = entry.for_output(getattr(m, key))
    con = duckdb.connect()
    for name in STAGING:
        con.register(name, staging.table(name).toArrow())
    rel = con.sql(over_staging(key))
    assert _bag([tuple(r) for r in sdf.collect()], sdf.columns) == _bag(rel.fetchall(), rel.columns)


def test_hot_duplicate_key_keeps_first(spark):
    rows = [("hot", i % 50, f"v{i:04d}") for i in range(3000)] + [("cold", 1, "x")]
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(6)
    out = keep_first(df, ["k"], ["o", "v"])
    assert sorted(map(tuple, out.collect())) == [("cold", 1, "x"), ("hot", 0, "v0000")]
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    # repeated keys are counted map-side, and at most a row per key and task leaves a task
    assert "partial_count" in plan and "WindowGroupLimit" in plan and ", Partial" in plan


def test_fan_out_is_not_materialised(frames):
    m = Marts(hot_staging(frames))
    df = m.category_revenue_delivery
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    # reviews and items are aggregated per order before any join on order_id
    assert plan.count("partial_count(1)") >= 2


def test_sql_views_match_dataframes(frames, spark):
    m = Marts(hot_staging(frames))
    m.register_views()
    for name in ("kpi_revenue_at_risk", "rfm_segment_summary", "cohort_retention_rates"):
        via_sql = spark.sql(f"SELECT * FROM {name}")
        assert sorted(map(tuple, via_sql.collect())) == sorted(map(tuple, getattr(m, name).collect()))
