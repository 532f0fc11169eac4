"""Presentation-level tables: exports' totals and top-N, the dashboard's
filters, KPI row, bands, shares, display names and labels.

All inputs here are marts that are already aggregated (a few rows to a few
thousand), except the totals: ``totals`` reads delivered orders (the
reference's form), ``totals_from`` the customer grain (what ``Marts`` uses).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import MONEY, cents, ratio_round, round_money
from ..functions.format import one_place_text, thousands, whole_units
from .conform import delivered_orders

ID = "customer_unique_id"


def totals(fact: DataFrame) -> DataFrame:
    """Delivered orders, their revenue (0 places) and distinct customers; one row."""
    d = delivered_orders(fact)
    return d.agg(F.count(F.lit(1)).alias("total_orders"),
                 round_money(F.sum("revenue"), 0).alias("total_revenue"),
                 F.count_distinct(ID).alias("total_customers"))


def totals_from(customers: DataFrame) -> DataFrame:
    """The same three numbers from the customer grain (``rfm.customer_orders``):
    orders = sum of per-customer counts, revenue = sum of per-customer sums,
    customers = its rows, so no distinct aggregation over the orders is needed."""
    return customers.agg(
        F.coalesce(F.sum("frequency"), F.lit(0)).cast("long").alias("total_orders"),
        round_money(F.sum("monetary"), 0).alias("total_revenue"),
        F.count(ID).alias("total_customers"))


def top_n(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """``ORDER BY by DESC LIMIT n`` with PostgreSQL's NULLS FIRST for DESC and a
    unique tie-break, planned as a per-partition top-k merge."""
    return df.orderBy(F.col(by).desc_nulls_first(), F.col(tie).asc_nulls_first()).limit(n)


def top_categories(category_mart: DataFrame, n: int = 15) -> DataFrame:
    return top_n(category_mart, "total_revenue", n, "category_en")


def top_seller_states(state_mart: DataFrame, n: int = 20) -> DataFrame:
    return top_n(state_mart, "avg_delay_days", n, "seller_state")


def _one_row(df: DataFrame, *cols: str):
    """The single row of a one-row frame as a struct-valued scalar subquery."""
    return df.select(F.struct(*cols).alias("r")).scalar()


def kpi_row(totals_df: DataFrame, kpi: DataFrame, repeat: DataFrame) -> DataFrame:
    """The five headline numbers in one record (one-row inputs, combined as
    scalar subqueries)."""
    j = totals_df.select("*", _one_row(kpi, "revenue_at_risk_pct", "revenue_at_risk").alias("_k"),
                         repeat.select("repeat_pct").scalar().alias("repeat_pct"))
    return j.select("total_orders", "total_revenue", "total_customers",
                    F.col("_k.revenue_at_risk_pct").alias("revenue_at_risk_pct"),
                    F.col("_k.revenue_at_risk").alias("revenue_at_risk"), "repeat_pct")


def safe_vs_risk(totals_df: DataFrame, kpi: DataFrame) -> DataFrame:
    """Two slices: total revenue (0 places) minus revenue at risk (2 places), and the latter."""
    j = totals_df.select("total_revenue",
                         kpi.select("revenue_at_risk").scalar().alias("revenue_at_risk"))
    safe = (F.col("total_revenue").cast(MONEY) - F.col("revenue_at_risk").cast(MONEY)).cast("double")
    return j.select(F.explode(F.array(
        F.struct(F.lit("Safe Revenue").alias("label"), safe.alias("revenue")),
        F.struct(F.lit("Revenue at Risk").alias("label"),
                 F.col("revenue_at_risk").alias("revenue"))))).select("col.*")


def delivery_bands(dvr: DataFrame) -> DataFrame:
    """Colour bands of the delivery charts: early/late by average delay, and
    low/medium/high by late share (> 10 high, > 5 medium)."""
    return dvr.select(
        "review_score", "avg_delivery_delay_days", "late_delivery_pct",
        F.when(F.col("avg_delivery_delay_days") > 0, "late").otherwise("early").alias("delay_band"),
        F.when(F.col("late_delivery_pct") > 10, "high")
         .when(F.col("late_delivery_pct") > 5, "medium").otherwise("low").alias("late_band"))


def state_bands(states: DataFrame) -> DataFrame:
    """Seller states: late (> 0 days), near (> -5), early."""
    return states.select(
        "seller_state", "avg_delay_days", "avg_review_score",
        F.when(F.col("avg_delay_days") > 0, "late")
         .when(F.col("avg_delay_days") > -5, "near").otherwise("early").alias("delay_band"))


def retention_bands(avg_retention: DataFrame) -> DataFrame:
    """Average retention: the acquisition month, then above or below 3%."""
    return avg_retention.select(
        "period_number", "avg_retention_pct",
        F.when(F.col("period_number") == 0, "acquisition")
         .when(F.col("avg_retention_pct") > 3, "above_3pct").otherwise("at_most_3pct")
         .alias("retention_band"))


def category_share(top_categories_df: DataFrame) -> DataFrame:
    """Each shown category's share of the shown revenue (treemap 'percent root'),
    2 places; the window runs over the at most N shown rows."""
    total = F.sum(cents("total_revenue")).over(Window.partitionBy())
    return top_categories_df.select(
        "category_en", "total_revenue",
        ratio_round(cents("total_revenue") * 100, total, 2).alias("share_pct"))


# The dashboard's display names for the segment table.
DISPLAY_NAMES = (
    ("rfm_segment", "Segment"),
    ("customer_count", "Customers"),
    ("total_revenue", "Revenue (R$)"),
    ("avg_revenue_per_customer", "Avg Revenue"),
    ("avg_recency_days", "Avg Recency (days)"),
    ("avg_frequency", "Avg Frequency"),
)


def segment_display_table(summary: DataFrame) -> DataFrame:
    return summary.select(*[F.col(src).alias(dst) for src, dst in DISPLAY_NAMES])


def segment_labels(summary: DataFrame) -> DataFrame:
    """Text labels of the segment charts: '12,345' customers, 'R$ 1,234' revenue."""
    return summary.select(
        "rfm_segment",
        thousands("customer_count").alias("customers_label"),
        F.concat(F.lit("R$ "), thousands(whole_units("total_revenue"))).alias("revenue_label"),
        F.concat(F.lit("R$ "), thousands(whole_units("avg_revenue_per_customer")))
         .alias("avg_revenue_label"))


def delivery_labels(dvr: DataFrame) -> DataFrame:
    """'+1.5d' / '-3.2d' average delay and '12.3%' late share per review score."""
    return dvr.select(
        "review_score",
        F.concat(one_place_text("avg_delivery_delay_days", signed=True), F.lit("d")).alias("delay_label"),
        F.concat(one_place_text("late_delivery_pct"), F.lit("%")).alias("late_label"))


def cohort_labels(rates: DataFrame) -> DataFrame:
    """Heatmap labels: 'Month +n' per period, '12.3%' per cell, blank for 0."""
    return rates.select(
        "cohort_month", "period_number",
        F.concat(F.lit("Month +"), F.col("period_number").cast("string")).alias("period_label"),
        F.when(F.col("retention_pct") > 0,
               F.concat(one_place_text("retention_pct"), F.lit("%"))).otherwise(F.lit(""))
         .alias("cell_label"))


def _reais(x) -> F.Column:
    return F.concat(F.lit("R$ "), thousands(x))


def _percent(x) -> F.Column:
    return F.concat(one_place_text(x), F.lit("%"))


def kpi_labels(kpi: DataFrame) -> DataFrame:
    """The headline numbers as text: '1,234', 'R$ 1,234', '12.3%'.  Total
    revenue is cut to whole units, as it has none but zeros after the point."""
    return kpi.select(
        thousands("total_orders").alias("orders_label"),
        _reais(F.col("total_revenue").cast("decimal(38,2)").cast("long")).alias("revenue_label"),
        thousands("total_customers").alias("customers_label"),
        _percent("revenue_at_risk_pct").alias("at_risk_pct_label"),
        _reais(whole_units("revenue_at_risk")).alias("at_risk_label"),
        _percent("repeat_pct").alias("repeat_label"))


def state_labels(states: DataFrame) -> DataFrame:
    """'★ 4.12': the average review score beside each seller state's bar."""
    hundredths = F.round(F.col("avg_review_score").cast("decimal(38,2)") * 100).cast("long")
    text = F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))
    return states.select("seller_state", F.concat(F.lit("★ "), F.coalesce(text, F.lit("nan"))).alias("score_label"))


def retention_labels(avg_retention: DataFrame) -> DataFrame:
    """'12.3%' per month after the first purchase."""
    return avg_retention.select("period_number", _percent("avg_retention_pct").alias("retention_label"))
