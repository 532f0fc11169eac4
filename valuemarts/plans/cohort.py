"""Monthly cohort retention marts (reference layer 4, cohorts)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_number, month_start, year_month_text
from ..functions.exact import exact_hundredths, ratio_round
from .conform import delivered_orders

ID = "customer_unique_id"


def cohort_base(fact: DataFrame) -> DataFrame:
    """Month of each customer's first delivered purchase."""
    return (delivered_orders(fact).groupBy(ID)
            .agg(F.min("order_purchase_timestamp").alias("first_order_date"))
            .select(ID, month_start("first_order_date").alias("cohort_month"), "first_order_date"))


def cohort_base_from(customers: DataFrame) -> DataFrame:
    """The same from the customer grain (``rfm.customer_orders``)."""
    return customers.select(ID, month_start("first_order_date").alias("cohort_month"),
                            "first_order_date")


def customer_order_months(fact: DataFrame) -> DataFrame:
    """Distinct (customer, month) pairs with a delivered order."""
    return (delivered_orders(fact)
            .select(ID, month_start("order_purchase_timestamp").alias("order_month"))
            .distinct())


@dataclass(frozen=True)
class MonthSpan:
    """First month and number of months of a (customer, month) grain."""

    first: date
    months: int

    @property
    def words(self) -> int:
        return -(-self.months // _WORD)


#: months per 64-bit word (the sign bit stays free)
_WORD = 63


def month_span(months: DataFrame) -> MonthSpan | None:
    """The span of the grain's months (one row to the driver); None if it has none."""
    r = months.agg(F.min("order_month").alias("lo"), F.max("order_month").alias("hi")).first()
    if r["lo"] is None:
        return None
    lo, hi = (x.date() if isinstance(x, datetime) else x for x in (r["lo"], r["hi"]))
    return MonthSpan(lo, (hi.year - lo.year) * 12 + hi.month - lo.month + 1)


def month_bits(span: MonthSpan) -> list[Column]:
    """Aggregates over a customer's rows: bit i of word w is set if there is an
    order in month 63 w + i of the span.  Rows without a month set none."""
    place = month_number("order_month", F.lit(span.first))
    return [F.coalesce(F.bit_or(F.when(F.floor(place / _WORD) == w, F.call_function("shiftleft", F.lit(1).cast("long"), place % _WORD))), F.lit(0).cast("long")).alias(f"months_{w}")
            for w in range(span.words)]


def cohort_retention_grid(customers: DataFrame, span: MonthSpan | None) -> DataFrame:
    """Customers of each cohort active ``period_number`` months after it, read
    off the month bits of the customer grain.

    Customers with equal bits are counted first, within each task; so one small
    row per pattern is shuffled, no customer is sorted or windowed, and the
    cells come from the patterns' bits: the lowest one is the cohort month.  A
    customer has a period once, hence the count equals the reference's
    COUNT(DISTINCT customer).  Customers without any dated order have no bits
    and match no cohort, as in the reference's join condition.
    """
    if span is None:
        return customers.where("false").select(F.col("first_order_date").cast("date").alias("cohort_month"), F.lit(0).alias("period_number"),
                                               F.lit(0).cast("long").alias("retained_customers"))
    words = [F.col(f"months_{w}") for w in range(span.words)]
    patterns = customers.groupBy(*words).agg(F.count(F.lit(1)).alias("c"))
    held = F.filter(F.sequence(F.lit(0), F.lit(span.months - 1)),
                    lambda i: F.call_function("shiftright", F.element_at(F.array(*words), (F.floor(i / _WORD) + 1).cast("int")), i % _WORD).bitwiseAND(F.lit(1).cast("long")) == 1)
    cells = patterns.select("c", held.alias("m")).where(F.size("m") > 0).select("c", F.element_at("m", 1).alias("first"), F.explode("m").alias("at"))
    return (cells.select(F.add_months(F.lit(span.first), F.col("first")).alias("cohort_month"), (F.col("at") - F.col("first")).alias("period_number"), "c")
            .groupBy("cohort_month", "period_number").agg(F.sum("c").alias("retained_customers")))


def cohort_sizes(base: DataFrame) -> DataFrame:
    """Customers per cohort month (customer rows in cohort_base are unique)."""
    return base.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("cohort_size"))


def cohort_retention_rates(grid: DataFrame) -> DataFrame:
    """Retention per (cohort, period), 2 places; the month is 'YYYY-MM' text.

    The cohort size is taken from the grid's own period-0 cell: every cohort
    member has an order in the cohort month, and only cohort members do, so
    it equals ``cohort_sizes`` for every cohort the reference's inner join
    keeps.  The grid holds one row per (cohort, period) — months squared at
    most, independent of order volume — so this window is tiny.
    """
    size = F.max(F.when(F.col("period_number") == 0, F.col("retained_customers"))) \
        .over(Window.partitionBy("cohort_month"))
    g = grid.select("*", size.alias("cohort_size")).where(F.col("cohort_size").isNotNull())
    return g.select(year_month_text("cohort_month").alias("cohort_month"),
                    "period_number",
                    F.col("retained_customers").cast("long").alias("retained_customers"),
                    F.col("cohort_size").cast("long").alias("cohort_size"),
                    ratio_round(F.col("retained_customers") * 100, "cohort_size", 2)
                    .alias("retention_pct"))


def cohort_avg_retention(rates: DataFrame) -> DataFrame:
    """Unweighted mean of the already rounded rates of the cohorts that have
    the cell (absent cells are not zeros), 2 places."""
    return (rates.groupBy("period_number")
            .agg(F.sum(exact_hundredths("retention_pct")).alias("_h"),
                 F.count("retention_pct").alias("_n"),
                 F.sum("retained_customers").alias("total_retained"),
                 F.sum("cohort_size").alias("total_cohort_size"))
            .select("period_number",
                    ratio_round("_h", F.col("_n") * 100, 2).alias("avg_retention_pct"),
                    F.col("total_retained").cast("long").alias("total_retained"),
                    F.col("total_cohort_size").cast("long").alias("total_cohort_size")))


def within_periods(df: DataFrame, max_period: int = 6) -> DataFrame:
    """The export filter ``period_number <= 6``."""
    return df.where(F.col("period_number") <= max_period)


def cohort_matrix(rates: DataFrame, max_period: int = 6) -> DataFrame:
    """Cohort × period matrix of retention_pct, missing cells 0 (dashboard heatmap).

    Pivot values are given, so Spark needs no extra job to find them.
    """
    periods = list(range(max_period + 1))
    wide = (within_periods(rates, max_period).groupBy("cohort_month")
            .pivot("period_number", periods).agg(F.first("retention_pct")))
    return wide.select("cohort_month", *[
        F.coalesce(F.col(str(p)), F.lit(0.0)).alias(f"period_{p}") for p in periods])
