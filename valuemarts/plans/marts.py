"""All marts over one set of staging tables.

``Marts(staging)`` composes the view functions the way the views reference
each other.  Seven grains feed the marts and are written once, as Parquet
below the session's checkpoint folder, when first needed: the order facts
(orders joined with customers and payments), the delivered orders with their
review weights, the items of delivered orders counted per category and per
seller state, the (customer, month) grain of the delivered orders, the customer
grain with its months as bits, and the RFM segments (whose quintiles take a few
small jobs).  The four order-grain ones are bucketed by order id, so the marts
that join them shuffle nothing by order.  So asking for a mart may run jobs; ``prepare()`` writes the
seven at once, ``release()`` deletes them.  With ``materialize=False`` nothing is
written and every mart is one lazy plan but for the quintiles' cut keys, the
heavy keys of the items, whether sellers or products repeat, the months' span and the scatter's threshold.

``register_views`` exposes every mart to ``spark.sql`` under the view names.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from ..operators import quality
from ..operators.skew import heavy_keys, is_unique, join_dimension
from ..session import delete_path, materialize
from ..sources.export import ordered
from . import cohort, conform, present, rfm, risk


class Marts:
    def __init__(self, staging, ntile_options: dict | None = None, materialize: bool = True):
        self.staging = staging
        self.ntile_options = ntile_options or {}
        self.materialize = materialize
        self._written: list[str] = []
        self.buckets = getattr(staging, "buckets", None)      # as the staging tables have, so that they meet

    def _once(self, df: DataFrame, name: str, bucket_by: str | None = None, arranged: bool = False) -> DataFrame:
        """``df``, written once if this context writes its grains."""
        if not self.materialize:
            return df
        out, path = materialize(df, name, bucket_by, arranged, self.buckets)
        self._written.append(path)
        return out

    def prepare(self) -> "Marts":
        """Write the shared grains now."""
        _ = (self.fact_orders, self.order_weights, self.order_categories, self.order_states,
             self.month_grain, self.customer_orders, self.rfm_segments)
        return self

    # -- staging -------------------------------------------------------------
    def stg(self, name: str) -> DataFrame:
        return getattr(self.staging, name)

    def staging_tables(self) -> dict[str, DataFrame]:
        return self.staging.tables()

    # -- conformed -----------------------------------------------------------
    @cached_property
    def dim_customers(self):
        return conform.dim_customers(self.stg("stg_customers"))

    @cached_property
    def dim_products(self):
        return conform.dim_products(self.stg("stg_products"),
                                    self.stg("stg_product_category_translation"))

    @cached_property
    def fact_orders(self):
        return self._once(conform.fact_orders(self.stg("stg_orders"), self.stg("stg_customers"),
                                              self.stg("stg_order_payments")), "fact_orders", "order_id")

    @cached_property
    def heavy_products(self) -> list[str]:
        """Products that hold a large share of the items."""
        return heavy_keys(self.stg("stg_order_items"), "product_id")

    @cached_property
    def heavy_sellers(self) -> list[str]:
        """Sellers that hold a large share of the items."""
        return heavy_keys(self.stg("stg_order_items"), "seller_id")

    def per_seller_row(self, items: DataFrame) -> DataFrame:
        """An item counts once per row of its seller; so they are joined only if sellers repeat."""
        sellers = self.stg("stg_sellers").select("seller_id")
        return items if is_unique(sellers, "seller_id") else join_dimension(items, sellers, "seller_id", self.heavy_sellers)

    def per_product_row(self, items: DataFrame) -> DataFrame:
        """The same for products."""
        products = self.dim_products.select("product_id")
        return items if is_unique(products, "product_id") else join_dimension(items, products, "product_id", self.heavy_products)

    @property
    def delivered_items(self):
        """Keys of the items of delivered orders, the only ones that the delivery
        marts count; where the tables are bucketed, unshuffled."""
        return (self.stg("stg_order_items").select("order_id", "product_id", "seller_id")
                .join(self.order_weights.select("order_id"), "order_id", "left_semi"))

    @cached_property
    def order_categories(self):
        items = self.per_seller_row(self.delivered_items).select("order_id", "product_id")
        items = conform.with_category(items, self.dim_products, self.heavy_products)
        return self._once(conform.items_per_order(items, "category_en", self.buckets), "order_categories", "order_id", arranged=True)

    @cached_property
    def order_states(self):
        items = self.per_product_row(self.delivered_items).select("order_id", "seller_id")
        items = conform.with_seller_state(items, self.stg("stg_sellers"), self.heavy_sellers)
        return self._once(conform.items_per_order(items, "seller_state", self.buckets), "order_states", "order_id", arranged=True)

    @cached_property
    def order_weights(self):
        return self._once(risk.order_weights(self.fact_orders, self.stg("stg_order_reviews")), "order_weights", "order_id")

    @cached_property
    def fact_order_items(self):
        return conform.fact_order_items(conform.with_category(
            self.per_seller_row(self.stg("stg_order_items").drop("shipping_limit_date")), self.dim_products, self.heavy_products))

    @cached_property
    def fact_reviews(self):
        return conform.fact_reviews(self.stg("stg_order_reviews"), self.fact_orders)

    # -- RFM -----------------------------------------------------------------
    @cached_property
    def month_grain(self):
        return self._once(rfm.month_grain(self.fact_orders), "month_grain")

    @cached_property
    def customer_orders(self):
        return self._once(rfm.customers_of(self.month_grain, self.month_span), "customer_orders")

    @cached_property
    def month_span(self):
        return cohort.month_span(self.month_grain)

    def release(self) -> None:
        """Delete the tables this context wrote under the checkpoint folder.
        Marts built from them must not be used afterwards."""
        spark = self.stg("stg_orders").sparkSession
        for path in self._written:
            delete_path(spark, path)
        self._written.clear()

    @cached_property
    def rfm_raw(self):
        if not self.materialize:
            return rfm.rfm_raw_from(self.customer_orders)
        # read once from the written grain; the NTILE passes then reuse a literal
        return rfm.rfm_raw_from(self.customer_orders, rfm.reference_date(self.customer_orders))

    @cached_property
    def rfm_scores(self):
        options = {"materialize": not self.materialize, **self.ntile_options}
        return rfm.rfm_scores(self.rfm_raw, **options)

    @cached_property
    def rfm_segments(self):
        return self._once(rfm.rfm_segments(self.rfm_scores), "rfm_segments")

    @cached_property
    def rfm_segment_summary(self):
        return rfm.rfm_segment_summary(self.rfm_segments)

    @cached_property
    def repeat_rate(self):
        return rfm.repeat_rate(self.rfm_raw)

    @cached_property
    def rfm_scatter(self):
        return rfm.rfm_scatter(self.rfm_segments)

    # -- cohorts -------------------------------------------------------------
    @cached_property
    def cohort_base(self):
        return cohort.cohort_base_from(self.customer_orders)

    @cached_property
    def customer_order_months(self):
        return self.month_grain.select(cohort.ID, "order_month")

    @cached_property
    def cohort_retention_grid(self):
        return cohort.cohort_retention_grid(self.customer_orders, self.month_span)

    @cached_property
    def cohort_sizes(self):
        return cohort.cohort_sizes(self.cohort_base)

    @cached_property
    def cohort_retention_rates(self):
        return cohort.cohort_retention_rates(self.cohort_retention_grid)

    @cached_property
    def cohort_avg_retention(self):
        return cohort.cohort_avg_retention(self.cohort_retention_rates)

    @cached_property
    def cohort_matrix(self):
        return cohort.cohort_matrix(self.cohort_retention_rates)

    # -- revenue at risk and delivery ---------------------------------------
    @cached_property
    def revenue_by_segment(self):
        return risk.revenue_by_segment(self.rfm_segments)

    @cached_property
    def kpi_revenue_at_risk(self):
        return risk.kpi_revenue_at_risk(self.revenue_by_segment)

    @cached_property
    def delivery_vs_review(self):
        return risk.delivery_vs_review(self.fact_orders, self.stg("stg_order_reviews"))

    @cached_property
    def delivery_delay_by_seller_state(self):
        return risk.delivery_delay_by_seller_state(self.order_states, self.order_weights)

    @cached_property
    def segment_delivery_experience(self):
        return risk.segment_delivery_experience(self.rfm_segments, self.order_weights)

    @cached_property
    def category_revenue_delivery(self):
        return risk.category_revenue_delivery(self.order_categories, self.order_weights)

    @cached_property
    def late_rate_ratio(self):
        return risk.late_rate_ratio(self.delivery_vs_review)

    # -- presentation --------------------------------------------------------
    @cached_property
    def totals(self):
        return present.totals_from(self.customer_orders)

    def top_categories(self, n: int = 15):
        return present.top_categories(self.category_revenue_delivery, n)

    def top_seller_states(self, n: int = 20):
        return present.top_seller_states(self.delivery_delay_by_seller_state, n)

    @cached_property
    def cohort_rates_6(self):
        return cohort.within_periods(self.cohort_retention_rates, 6)

    @cached_property
    def cohort_avg_6(self):
        return cohort.within_periods(self.cohort_avg_retention, 6)

    @cached_property
    def kpi_row(self):
        return present.kpi_row(self.totals, self.kpi_revenue_at_risk, self.repeat_rate)

    @cached_property
    def safe_vs_risk(self):
        return present.safe_vs_risk(self.totals, self.kpi_revenue_at_risk)

    # -- data quality --------------------------------------------------------
    def dq_pk_violations(self):
        return quality.pk_violations(self.staging_tables())

    def dq_column_violations(self):
        return quality.column_violations(self.staging_tables())

    def dq_null_counts(self):
        return quality.null_counts(self.dq_column_violations())

    def dq_domain_violations(self):
        return quality.domain_violations(self.dq_column_violations())

    def dq_orphans(self):
        return quality.orphans(self.staging_tables())

    # -- SQL surface ---------------------------------------------------------
    # The public view names.
    VIEW_NAMES = (
        "dim_customers", "dim_products", "fact_orders", "fact_order_items", "fact_reviews",
        "rfm_raw", "rfm_scores", "rfm_segments", "rfm_segment_summary",
        "cohort_base", "customer_order_months", "cohort_retention_grid", "cohort_sizes",
        "cohort_retention_rates", "cohort_avg_retention",
        "revenue_by_segment", "kpi_revenue_at_risk", "delivery_vs_review",
        "delivery_delay_by_seller_state", "segment_delivery_experience",
        "category_revenue_delivery",
    )

    def register_views(self, include_staging: bool = True) -> None:
        """Temp views under the reference's names, so ``spark.sql`` can query them."""
        if include_staging:
            for name, df in self.staging_tables().items():
                df.createOrReplaceTempView(name)
        for name in self.VIEW_NAMES:
            getattr(self, name).createOrReplaceTempView(name)

    # The exported marts and the order of their rows.  A unique
    # column breaks ties; NULLs come first in descending order, as in the
    # original engine.
    EXPORT_ORDER = {
        "rfm_segment_summary": ("-total_revenue", "rfm_segment"),
        "delivery_vs_review": ("review_score",),
        "segment_delivery_experience": ("-segment_revenue", "rfm_segment"),
        "category_revenue_delivery": ("-total_revenue", "category_en"),
        "delivery_delay_by_seller_state": ("-avg_delay_days", "seller_state"),
        "cohort_retention_rates": ("cohort_month", "period_number"),
        "cohort_avg_retention": ("period_number",),
    }

    def exports(self) -> dict[str, DataFrame]:
        """The exported marts with the export's filter, order and limit."""
        marts = {
            "rfm_segment_summary": self.rfm_segment_summary,
            "kpi_revenue_at_risk": self.kpi_revenue_at_risk,
            "delivery_vs_review": self.delivery_vs_review,
            "segment_delivery_experience": self.segment_delivery_experience,
            "category_revenue_delivery": self.top_categories(15),
            "delivery_delay_by_seller_state": self.top_seller_states(20),
            "cohort_retention_rates": self.cohort_rates_6,
            "cohort_avg_retention": self.cohort_avg_6,
            "totals": self.totals,
            "repeat_rate": self.repeat_rate,
            "rfm_scatter": self.rfm_scatter,
        }
        return {name: ordered(df, *self.EXPORT_ORDER[name]) if name in self.EXPORT_ORDER else df
                for name, df in marts.items()}
