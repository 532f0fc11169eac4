"""The narrow grains of the delivery marts: results, and what they read and shuffle."""

import re
from collections import Counter

from pyspark.sql import functions as F
from test_written_once import rows_of, write_tables

from valuemarts.plans import conform
from valuemarts.plans.marts import Marts
from valuemarts.session import materialize
from valuemarts.sources.testdata import TestDataStaging


def test_delivery_marts_join_only_what_they_count(spark, tmp_path):
    """Categories need no seller, states no product; items of undelivered orders are not joined."""
    plain = TestDataStaging(spark, write_tables(spark, tmp_path / "in"))
    lazy, categories = Marts(plain, materialize=False), Marts(plain)
    for mart, other in (("order_categories", "seller_id"), ("order_states", "product_id")):
        plan = getattr(lazy, mart)._jdf.queryExecution().optimizedPlan().toString()
        assert "order_id" in plan and other not in plan
    delivered = {r.order_id for r in categories.order_weights.collect()}
    assert {r.order_id for r in categories.order_categories.collect()} <= delivered
    items = [r for r in plain.stg_order_items.collect() if r.order_id in delivered]
    product = {r.product_id: r.category_en for r in categories.dim_products.collect()}
    want = Counter((r.order_id, product.get(r.product_id)) for r in items)
    # an order row that is repeated does not repeat its items here, but in the join with the weights
    assert {(r.order_id, r.category_en): r.n_items for r in categories.order_categories.collect()} == want
    categories.release()


def test_an_item_counts_once_per_row_of_its_seller_and_product(spark, tmp_path):
    plain = TestDataStaging(spark, write_tables(spark, tmp_path / "in"))
    once = Marts(plain, materialize=False)
    single = [rows_of(x) for x in (once.fact_order_items, once.order_categories, once.order_states)]
    sellers, products = plain.stg_sellers, plain.stg_products
    twice = TestDataStaging(spark, plain.sf_dir)
    twice.__dict__["stg_sellers"], twice.__dict__["stg_products"] = sellers.union(sellers.where("seller_id = 's2'")), products
    items = plain.stg_order_items.drop("shipping_limit_date")
    want = items.join(twice.stg_sellers.select("seller_id"), "seller_id", "left").join(once.dim_products.select("product_id", "category_en"), "product_id", "left")
    columns = ("order_id", "order_item_id", "product_id", "seller_id", "category_en")
    m = Marts(twice, materialize=False)
    assert rows_of(m.fact_order_items.select(*columns)) == rows_of(want.select(*columns)) and m.fact_order_items.count() > sum(single[0].values())
    per_order = want.join(m.order_weights.select("order_id"), "order_id", "left_semi").groupBy("order_id", "category_en").agg(F.count(F.lit(1)))
    assert rows_of(m.order_categories) == rows_of(per_order) != single[1]
    twice.__dict__["stg_sellers"], twice.__dict__["stg_products"] = sellers, products.union(products.where("product_id = 'p3'"))
    m = Marts(twice, materialize=False)
    assert m.fact_order_items.count() > sum(single[0].values())
    grown = {r.order_id: r.n for r in m.order_states.groupBy("order_id").agg(F.sum("n_items").alias("n")).collect()}
    of_p3 = Counter(r.order_id for r in plain.stg_order_items.where("product_id = 'p3' and seller_id <> 's5'").collect())
    before = Counter()
    for order_id, _, n in single[2]:
        before[order_id] += n
    assert grown == {o: n + of_p3[o] for o, n in before.items()}


def test_counts_per_order_are_shuffled_once_by_order(spark):
    items = spark.range(500, numPartitions=4).selectExpr("concat('o', id % 90) as order_id", "id % 4 as c", "id as unused")
    out = conform.items_per_order(items, "c", 6)
    assert rows_of(out) == rows_of(items.groupBy("order_id", "c").agg(F.count(F.lit(1)).alias("n_items")))
    df, _ = materialize(out, "per-order-test", "order_id", arranged=True, buckets=6)
    assert rows_of(df) == rows_of(out)
    joined = df.groupBy("order_id").agg(F.sum("n_items").alias("n"))
    assert joined.count() == 90 and rows_of(joined) == rows_of(items.groupBy("order_id").agg(F.count(F.lit(1)).alias("n")))
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"\bExchange ", plan)) == 1
