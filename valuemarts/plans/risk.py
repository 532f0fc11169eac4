"""Revenue-at-risk and delivery-experience marts (reference layer 4).

Three of the reference's delivery marts join orders to items and to reviews
on the same order key, so an order contributes items × reviews rows and the
averages and sums are weighted by that product.  Those weights are kept
exactly, but the product is never materialised: items and reviews are each
pre-aggregated per order (map-side combined, so a hot order or customer is
reduced before any shuffle), joined 1:1 per order, and every sum over the
fanned-out rows is rebuilt as (per-order value) × (item count) × (review
count, or 1 when an order has no review because the join is LEFT).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import MONEY, cents, exact_hundredths, ratio_round, round_money
from .conform import delivered_orders

ID = "customer_unique_id"

# The segments the reference counts as revenue at risk.
AT_RISK_SEGMENTS = ("At-Risk", "Lost", "About to Sleep")


def reviews_per_order(stg_order_reviews: DataFrame) -> DataFrame:
    """Review count and score sum per order."""
    return (stg_order_reviews.groupBy("order_id")
            .agg(F.count(F.lit(1)).alias("n_reviews"),
                 F.sum(F.col("review_score").cast("long")).alias("score_sum"),
                 F.count("review_score").alias("score_n")))


def order_weights(fact: DataFrame, stg_order_reviews: DataFrame) -> DataFrame:
    """Delivered orders with their review aggregate; ``w`` = rows one order row
    becomes after the reference's LEFT JOIN to reviews.  The three fan-out marts
    read it.  Both sides are grouped or bucketed by order, so where the tables
    are bucketed nothing is shuffled."""
    fo = delivered_orders(fact).select("order_id", ID, "revenue", "delivery_delay_days")
    return fo.join(reviews_per_order(stg_order_reviews), "order_id", "left").select(
        "order_id", ID, "revenue", "delivery_delay_days", F.coalesce(F.col("n_reviews"), F.lit(1)).alias("w"),
        F.coalesce(F.col("score_sum"), F.lit(0)).alias("score_sum"), F.coalesce(F.col("score_n"), F.lit(0)).alias("score_n"))


def _late(delay: str = "delivery_delay_days") -> F.Column:
    return F.when(F.col(delay) > 0, 1).otherwise(0)


# -- revenue concentration ----------------------------------------------------

def revenue_by_segment(segments: DataFrame) -> DataFrame:
    """Revenue per segment and its share of all segments' revenue.

    The grand total is a window over the aggregated segment rows (at most 8).
    """
    g = segments.groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("customer_count"),   # customers are unique rows here
        F.sum("monetary").alias("_m"))
    total = F.sum("_m").over(Window.partitionBy())
    return g.select(
        "rfm_segment", F.col("customer_count").cast("long").alias("customer_count"),
        round_money("_m").alias("segment_revenue"),
        ratio_round(cents("_m") * 100, cents(total), 2).alias("revenue_share_pct"),
        F.when(F.col("rfm_segment").isin(*AT_RISK_SEGMENTS), 1).otherwise(0).alias("is_at_risk"))


def kpi_revenue_at_risk(by_segment: DataFrame) -> DataFrame:
    """Sums of the already rounded at-risk revenue and shares; always one row."""
    r = by_segment.where(F.col("is_at_risk") == 1)
    return r.agg(
        round_money(F.sum(F.col("segment_revenue").cast(MONEY))).alias("revenue_at_risk"),
        round_money(F.sum(F.col("revenue_share_pct").cast(MONEY))).alias("revenue_at_risk_pct"))


# -- delivery vs review -------------------------------------------------------

def delivery_vs_review(fact: DataFrame, stg_order_reviews: DataFrame) -> DataFrame:
    """Per review score over reviews of orders with a known delay (the
    reference reads ``fact_reviews``: reviews inner-joined to orders).

    Reviews are first counted per (order, score) — at most five rows per
    order — so an order with a huge number of reviews is one row per score
    before the join.  ``order_count`` counts reviews, as the reference does.
    """
    per_order = (stg_order_reviews.groupBy("order_id", "review_score")
                 .agg(F.count(F.lit(1)).alias("n")))
    fo = (fact.where(F.col("delivery_delay_days").isNotNull())
          .select("order_id", "delivery_delay_days"))
    d = per_order.join(fo, "order_id")
    g = d.groupBy("review_score").agg(
        F.sum("n").alias("order_count"),
        F.sum(F.col("n") * F.col("delivery_delay_days")).alias("_s"),
        F.min("delivery_delay_days").alias("min_delay_days"),
        F.max("delivery_delay_days").alias("max_delay_days"),
        F.sum(F.col("n") * _late()).alias("_late"))
    return g.select(
        F.col("review_score").cast("int").alias("review_score"),
        F.col("order_count").cast("long").alias("order_count"),
        ratio_round("_s", "order_count", 2).alias("avg_delivery_delay_days"),
        F.col("min_delay_days").cast("int").alias("min_delay_days"),
        F.col("max_delay_days").cast("int").alias("max_delay_days"),
        ratio_round(F.col("_late") * 100, "order_count", 2).alias("late_delivery_pct"))


def late_rate_ratio(dvr: DataFrame, low: int = 1, high: int = 5) -> DataFrame:
    """How many times more often a ``low``-star review follows a late delivery
    than a ``high``-star one, from the rounded late percentages; one row."""
    p_low = F.max(F.when(F.col("review_score") == low, F.col("late_delivery_pct")))
    p_high = F.max(F.when(F.col("review_score") == high, F.col("late_delivery_pct")))
    g = dvr.agg(p_low.alias("late_pct_low"), p_high.alias("late_pct_high"))
    return g.select("late_pct_low", "late_pct_high",
                    ratio_round(exact_hundredths("late_pct_low"), exact_hundredths("late_pct_high"), 2)
                    .alias("late_rate_ratio"))


# -- fan-out marts, computed without the fan-out ------------------------------

def delivery_delay_by_seller_state(per_order: DataFrame, weights: DataFrame) -> DataFrame:
    """Delivered orders with a known delay, by seller state, weighted by
    items × reviews per order as in the reference (``conform.items_per_order``
    of the sellers' states, :func:`order_weights`)."""
    x = per_order.join(weights.where(F.col("delivery_delay_days").isNotNull()), "order_id")
    rows = F.col("n_items") * F.col("w")
    g = x.groupBy("seller_state").agg(
        F.count(F.lit(1)).alias("delivered_order_count"),  # one row per (order, state)
        F.sum(rows).alias("_rows"),
        F.sum(rows * F.col("delivery_delay_days")).alias("_delay"),
        F.sum(rows * _late()).alias("_late"),
        F.sum(F.col("n_items") * F.col("score_sum")).alias("_score"),
        F.sum(F.col("n_items") * F.col("score_n")).alias("_score_n"))
    return g.select(
        "seller_state", F.col("delivered_order_count").cast("long").alias("delivered_order_count"),
        ratio_round("_delay", "_rows", 2).alias("avg_delay_days"),
        ratio_round(F.col("_late") * 100, "_rows", 2).alias("late_pct"),
        ratio_round("_score", "_score_n", 2).alias("avg_review_score"))


def segment_delivery_experience(segments: DataFrame, weights: DataFrame) -> DataFrame:
    """Delivery experience per segment, weighted by reviews per delivered
    order (:func:`order_weights`); ``segment_revenue`` repeats each customer's
    total once per such row, as in the reference (so it differs from
    revenue_by_segment)."""
    x = weights
    known = F.col("delivery_delay_days").isNotNull()
    per_customer = x.groupBy(ID).agg(
        F.sum("w").alias("rows"),
        F.sum(F.when(known, F.col("w") * F.col("delivery_delay_days"))).alias("delay_sum"),
        F.sum(F.when(known, F.col("w"))).alias("delay_n"),
        F.sum(F.col("w") * _late()).alias("late"),
        F.sum("score_sum").alias("score_sum"),
        F.sum("score_n").alias("score_n"))
    j = segments.select(ID, "rfm_segment", "monetary").join(per_customer, ID)
    g = j.groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.sum(F.col("monetary") * F.col("rows")).alias("_rev"),
        F.sum("delay_sum").alias("_d"), F.sum("delay_n").alias("_dn"),
        F.sum("score_sum").alias("_s"), F.sum("score_n").alias("_sn"),
        F.sum("late").alias("_late"), F.sum("rows").alias("_rows"))
    return g.select(
        "rfm_segment", F.col("customer_count").cast("long").alias("customer_count"),
        round_money("_rev").alias("segment_revenue"),
        ratio_round("_d", "_dn", 2).alias("avg_delivery_delay_days"),
        ratio_round("_s", "_sn", 2).alias("avg_review_score"),
        ratio_round(F.col("_late") * 100, "_rows", 2).alias("late_delivery_pct"))


def category_revenue_delivery(per_order: DataFrame, weights: DataFrame) -> DataFrame:
    """Per category (NULL is a group) over delivered orders; order revenue
    repeats once per item × review, as in the reference (``conform.items_per_order``
    of the categories, :func:`order_weights`)."""
    x = per_order.join(weights, "order_id")
    rows = F.col("n_items") * F.col("w")
    known = F.col("delivery_delay_days").isNotNull()
    g = x.groupBy("category_en").agg(
        F.count(F.lit(1)).alias("order_count"),  # one row per (order, category)
        F.sum(F.col("revenue") * rows).alias("_rev"),
        F.sum(F.when(known, rows * F.col("delivery_delay_days"))).alias("_d"),
        F.sum(F.when(known, rows)).alias("_dn"),
        F.sum(F.col("n_items") * F.col("score_sum")).alias("_s"),
        F.sum(F.col("n_items") * F.col("score_n")).alias("_sn"))
    return g.select(
        "category_en", F.col("order_count").cast("long").alias("order_count"),
        round_money("_rev").alias("total_revenue"),
        ratio_round("_d", "_dn", 2).alias("avg_delay_days"),
        ratio_round("_s", "_sn", 2).alias("avg_review_score"))
