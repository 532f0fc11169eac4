"""Recency-frequency-monetary marts (reference layer 4, RFM)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_diff, month_start
from ..functions.exact import cents, ratio_round, round_money
from ..operators.ntile import NtileSpec, add_ntiles
from ..operators.topk import first_by_hash
from .cohort import MonthSpan, month_bits
from .conform import delivered_orders

ID = "customer_unique_id"

# The reference's segment rules on (r_score, f_score), first match wins.
SEGMENT_RULES = (
    ("Champions", lambda r, f: (r >= 4) & (f >= 4)),
    ("Loyal", lambda r, f: (r >= 3) & (f >= 3)),
    ("Promising", lambda r, f: (r >= 4) & (f <= 2)),
    ("Needs Attention", lambda r, f: (r == 3) & (f >= 2)),
    ("At-Risk", lambda r, f: (r <= 2) & (f >= 3)),
    ("About to Sleep", lambda r, f: (r == 2) & (f <= 2)),
    ("Lost", lambda r, f: r == 1),
)
OTHER_SEGMENT = "Others"


def customer_orders(fact: DataFrame) -> DataFrame:
    """Customer grain of the delivered orders, in one aggregation: first and
    last purchase, delivered order count, revenue sum (NULL if no delivered
    order has payments).  RFM, the cohort base and the totals all read it."""
    return (delivered_orders(fact).groupBy(ID)
            .agg(F.min("order_purchase_timestamp").alias("first_order_date"),
                 F.max("order_purchase_timestamp").alias("last_order_date"),
                 F.count(F.lit(1)).cast("long").alias("frequency"),
                 F.sum("revenue").alias("monetary")))


def month_grain(fact: DataFrame) -> DataFrame:
    """(customer, month) grain of the delivered orders, in one aggregation:
    first and last purchase, order count, revenue sum.  The customer grain,
    the cohorts and the totals come from it."""
    return (delivered_orders(fact)
            .groupBy(ID, month_start("order_purchase_timestamp").alias("order_month"))
            .agg(F.min("order_purchase_timestamp").alias("first_order_date"),
                 F.max("order_purchase_timestamp").alias("last_order_date"),
                 F.count(F.lit(1)).cast("long").alias("frequency"),
                 F.sum("revenue").alias("monetary")))


def customers_of(months: DataFrame, span: MonthSpan | None = None) -> DataFrame:
    """The customer grain from the (customer, month) grain; with ``span`` it
    also holds the customer's months as bits (``cohort.month_bits``)."""
    bits = month_bits(span) if span else []
    return (months.groupBy(ID)
            .agg(F.min("first_order_date").alias("first_order_date"),
                 F.max("last_order_date").alias("last_order_date"),
                 F.sum("frequency").alias("frequency"),
                 F.sum("monetary").alias("monetary"), *bits))


def reference_date(customers: DataFrame):
    """The latest delivered purchase overall, as one value (one small job;
    use it on a materialised customer grain)."""
    return customers.agg(F.max("last_order_date").alias("r")).first()["r"]


def rfm_raw_from(customers: DataFrame, ref_date=None) -> DataFrame:
    """Recency against the latest delivered purchase overall.

    With ``ref_date`` given (see :func:`reference_date`) it is a date literal;
    otherwise it is a scalar subquery over ``customers``, used inside the
    projection.  Neither needs a join."""
    if ref_date is None:
        ref = customers.agg(F.max("last_order_date")).scalar()
    else:
        ref = F.lit(ref_date.date() if hasattr(ref_date, "date") else ref_date)
    return customers.select(ID, day_diff(ref, "last_order_date").alias("recency_days"),
                            "frequency", "monetary")


def rfm_raw(fact: DataFrame) -> DataFrame:
    """Per customer with a delivered order: days since the last purchase,
    delivered order count, revenue sum."""
    return rfm_raw_from(customer_orders(fact))


def rfm_scores(raw: DataFrame, **ntile_options) -> DataFrame:
    """Quintile scores; 5 is best on every axis.  Ties are ordered by
    customer_unique_id, NULL monetary sorts last (PostgreSQL ASC)."""
    scored = add_ntiles(raw.select(ID, "recency_days", "frequency", "monetary"),
                        [NtileSpec("recency_days", "_r"), NtileSpec("frequency", "f_score"),
                         NtileSpec("monetary", "m_score")], ID, **ntile_options)
    return scored.select(ID, "recency_days", "frequency",
                         F.round(F.col("monetary"), 2).alias("monetary"),
                         (F.lit(6) - F.col("_r")).cast("int").alias("r_score"),
                         "f_score", "m_score")


def segment_of(r, f) -> F.Column:
    r = F.col(r) if isinstance(r, str) else r
    f = F.col(f) if isinstance(f, str) else f
    expr = None
    for name, rule in SEGMENT_RULES:
        expr = (F.when(rule(r, f), F.lit(name)) if expr is None
                else expr.when(rule(r, f), F.lit(name)))
    return expr.otherwise(F.lit(OTHER_SEGMENT))


def rfm_segments(scores: DataFrame) -> DataFrame:
    return scores.select(ID, "recency_days", "frequency", "monetary", "r_score", "f_score",
                         "m_score",
                         (F.col("r_score") + F.col("f_score") + F.col("m_score")).cast("int")
                         .alias("rfm_total"),
                         segment_of("r_score", "f_score").alias("rfm_segment"))


def rfm_segment_summary(segments: DataFrame) -> DataFrame:
    """Per segment.  AVG(monetary) skips NULL-monetary customers; COUNT(*) does not."""
    g = segments.groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.sum("monetary").alias("_money"),
        F.count("monetary").alias("_money_n"),
        F.sum("recency_days").alias("_rec"),
        F.count("recency_days").alias("_rec_n"),
        F.sum("frequency").alias("_freq"),
        F.count("frequency").alias("_freq_n"))
    return g.select(
        "rfm_segment", F.col("customer_count").cast("long").alias("customer_count"),
        round_money("_money").alias("total_revenue"),
        ratio_round(cents("_money"), F.col("_money_n") * 100, 2).alias("avg_revenue_per_customer"),
        ratio_round("_rec", "_rec_n", 1).alias("avg_recency_days"),
        ratio_round("_freq", "_freq_n", 2).alias("avg_frequency"))


def repeat_rate(raw: DataFrame) -> DataFrame:
    """Share of customers (with a delivered order) that have more than one, 1 place."""
    return raw.agg(ratio_round(F.sum(F.when(F.col("frequency") > 1, 1).otherwise(0)) * 100,
                               F.count(F.lit(1)), 1).alias("repeat_pct"))


def rfm_scatter(segments: DataFrame, size: int = 6000) -> DataFrame:
    """Deterministic sample of ``size`` customers for the recency/spend chart:
    the first ``size`` by md5 of the id."""
    return first_by_hash(segments.select(ID, "recency_days", "monetary", "frequency", "rfm_segment"), ID, size)


def filter_segments(df: DataFrame, segments: Sequence[str]) -> DataFrame:
    """The dashboard's segment multi-select."""
    return df.where(F.col("rfm_segment").isin(list(segments)))
