"""Conformed dimensions and facts (reference layer 3).

Each function takes staging DataFrames and returns a lazy DataFrame; none
sorts.  Join strategies are left to Catalyst/AQE: small dimensions (category
translation, sellers) are broadcast when their measured size is under
``spark.sql.autoBroadcastJoinThreshold``.  Staging tables bucketed by order id
meet on it without a shuffle; items meet products and sellers in joins that are
split at heavy keys (``operators.skew``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_diff
from ..operators.skew import join_dimension
from ..session import default_buckets

DELIVERED = "delivered"


def dim_customers(stg_customers: DataFrame) -> DataFrame:
    """One row per customer_unique_id; city and state are each the lexical MAX
    of their column, independently (as the reference does)."""
    return (stg_customers.groupBy("customer_unique_id")
            .agg(F.max("customer_city").alias("customer_city"),
                 F.max("customer_state").alias("customer_state")))


def dim_products(stg_products: DataFrame, translation: DataFrame) -> DataFrame:
    p = stg_products.alias("p")
    t = translation.alias("t")
    return (p.join(t, F.col("p.product_category_name") == F.col("t.product_category_name"), "left")
            .select(F.col("p.product_id").alias("product_id"),
                    F.coalesce(F.col("t.product_category_name_english"),
                               F.col("p.product_category_name"), F.lit("unknown")).alias("category_en"),
                    F.col("p.product_weight_g").alias("product_weight_g"),
                    F.col("p.product_photos_qty").alias("product_photos_qty")))


def order_payments_total(stg_order_payments: DataFrame) -> DataFrame:
    """SUM(payment_value) per order — pre-aggregated so the join does not fan out."""
    return (stg_order_payments.groupBy("order_id")
            .agg(F.sum("payment_value").alias("total_payment_value")))


def fact_orders(stg_orders: DataFrame, stg_customers: DataFrame,
                stg_order_payments: DataFrame) -> DataFrame:
    """One row per order of a known customer, all statuses.

    Payments come first: bucketed by order, they meet the orders without a
    shuffle.  ``revenue`` is the order's payment total when delivered, else NULL (also
    NULL for a delivered order without payment rows).  When a mart does not
    use the payment columns, Catalyst removes the payment join entirely.
    """
    o = stg_orders.alias("o")
    c = stg_customers.select("customer_id", "customer_unique_id").alias("c")
    pay = order_payments_total(stg_order_payments).alias("pay")
    return (o.join(pay, F.col("o.order_id") == F.col("pay.order_id"), "left")
            .join(c, F.col("o.customer_id") == F.col("c.customer_id"))
            .select(F.col("o.order_id").alias("order_id"),
                    F.col("c.customer_unique_id").alias("customer_unique_id"),
                    F.col("o.order_status").alias("order_status"),
                    F.col("o.order_purchase_timestamp").alias("order_purchase_timestamp"),
                    F.col("o.order_approved_at").alias("order_approved_at"),
                    F.col("o.order_delivered_customer_date").alias("order_delivered_customer_date"),
                    F.col("o.order_estimated_delivery_date").alias("order_estimated_delivery_date"),
                    day_diff("o.order_delivered_customer_date", "o.order_estimated_delivery_date")
                    .alias("delivery_delay_days"),
                    F.col("pay.total_payment_value").alias("total_payment_value"),
                    F.when(F.col("o.order_status") == DELIVERED, F.col("pay.total_payment_value"))
                    .alias("revenue")))


def delivered_orders(fact: DataFrame) -> DataFrame:
    return fact.where(F.col("order_status") == DELIVERED)


def with_category(items: DataFrame, dim_prod: DataFrame, heavy_products: Sequence[str] = ()) -> DataFrame:
    """Items with their product's category, NULL (not 'unknown') where the
    product has no row.  The join is split at the heavy keys, so a hot product
    is no hot task; all columns of ``items`` are shuffled, so callers select."""
    return join_dimension(items, dim_prod.select("product_id", "category_en"), "product_id", heavy_products)


def with_seller_state(items: DataFrame, stg_sellers: DataFrame, heavy_sellers: Sequence[str] = ()) -> DataFrame:
    """Items of known sellers with the seller's state; split and narrow as in
    :func:`with_category`."""
    return join_dimension(items, stg_sellers.select("seller_id", "seller_state"), "seller_id", heavy_sellers, "inner")


def items_per_order(items: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """Items per order and ``column``, in as many partitions by order as its
    bucketed table has: the rows are shuffled once, by order alone."""
    return (items.select("order_id", column).repartition(buckets or default_buckets(items.sparkSession), "order_id")
            .groupBy("order_id", column).agg(F.count(F.lit(1)).alias("n_items")))


def fact_order_items(items: DataFrame) -> DataFrame:
    """Items with their category (from :func:`with_category`)."""
    return items.select("order_id", "order_item_id", "product_id", "seller_id", "category_en", "price", "freight_value",
                        (F.col("price") + F.col("freight_value")).alias("item_total"))


def fact_reviews(stg_order_reviews: DataFrame, fact: DataFrame) -> DataFrame:
    """One row per review of a known order."""
    r = stg_order_reviews.alias("r")
    fo = fact.select("order_id", "customer_unique_id", "order_delivered_customer_date",
                     "delivery_delay_days").alias("fo")
    return (r.join(fo, F.col("r.order_id") == F.col("fo.order_id"))
            .select(F.col("r.review_id").alias("review_id"),
                    F.col("r.order_id").alias("order_id"),
                    F.col("fo.customer_unique_id").alias("customer_unique_id"),
                    F.col("r.review_score").cast("int").alias("review_score"),
                    F.col("r.review_creation_date").alias("review_creation_date"),
                    F.col("fo.order_delivered_customer_date").alias("order_delivered_customer_date"),
                    F.col("fo.delivery_delay_days").alias("delivery_delay_days")))
