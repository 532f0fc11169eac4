"""

Staging tables come from the driver's parquet tables
(``valuemarts.sources.testdata``).  The ingest-level queries (``stg_*``,
keep-first, PK check) run from the raw tables; the loader's report and the
coerced timestamps come from a run of the loader over CSV copies; the column
and orphan checks read tables with faults set by rule; the mart queries read
staging tables, of which those by order are written once per session and
folder.  ``oracle_sql`` gives
DuckDB SQL for the keys (``oracles/duckdb_sql.py``).  Exact decimals are
returned as DOUBLE and SMALLINT as INT on both sides so the schemas compare
equal.
"""

from __future__ import annotations

import atexit
import os
import sys
import uuid
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from valuemarts.operators import quality  # noqa: E402
from valuemarts.operators.dedup import keep_first  # noqa: E402
from valuemarts.plans import present, rfm  # noqa: E402
from valuemarts.plans.marts import Marts  # noqa: E402
from valuemarts.session import checkpoint_dir, delete_path  # noqa: E402
from valuemarts.sources.export import export_marts, load_mart, with_position  # noqa: E402
from valuemarts.sources.ingest import LoadError, ParquetStaging, load_all  # noqa: E402
from valuemarts.sources.spec import STAGING  # noqa: E402
from valuemarts.sources.testdata import (  # noqa: E402
    LINEITEM_ORDER, LINEITEM_PK, FaultyStaging, TestDataStaging, WrittenStaging, write_csv, write_staging)

# the text operators and the pipeline are an optional part
try:
    from valuemarts.llm import queries as llm  # noqa: E402
except ImportError:
    llm = None
try:
    import corpus_pipeline  # noqa: E402
except ImportError:
    corpus_pipeline = None

SMOKE_DIR = "/root/testdata/sf0.001"
SEGMENT_FILTER = ("Champions", "Loyal", "At-Risk")


def for_output(df: DataFrame) -> DataFrame:
    """DECIMAL → DOUBLE, SMALLINT → INT for the comparison with the oracle."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            cols.append(F.col(f"`{f.name}`").cast("double").alias(f.name))
        elif isinstance(f.dataType, (T.ShortType, T.ByteType)):
            cols.append(F.col(f"`{f.name}`").cast("int").alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


_CONTEXTS: dict[tuple[str, str], "Context"] = {}


class Context:
    """What the queries of one session and folder share: the staging tables
    written once, those that a query reads, one ``Marts`` over
    them, the loader's run over CSV copies, and the exports."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.raw = TestDataStaging(spark, sf_dir)
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/valuemarts/context-{uuid.uuid4().hex}"

    @cached_property
    def staging(self) -> WrittenStaging:
        return WrittenStaging(TestDataStaging(self.spark, self.sf_dir), f"{self.root}/staging")   # own instance: it is rewired

    @cached_property
    def marts(self) -> Marts:
        return Marts(self.staging)

    @cached_property
    def loaded(self) -> tuple[DataFrame, ParquetStaging]:
        """The loader's report over CSV copies of the tables, and what it loaded."""
        write_csv(TestDataStaging(self.spark, self.sf_dir, dedup=False), f"{self.root}/csv")
        report = load_all(self.spark, f"{self.root}/csv", f"{self.root}/loaded")
        delete_path(self.spark, f"{self.root}/csv")
        return report, ParquetStaging(self.spark, f"{self.root}/loaded")

    @cached_property
    def faulty(self) -> ParquetStaging:
        """The tables with faults set by rule, written once."""
        write_staging(FaultyStaging(TestDataStaging(self.spark, self.sf_dir)), f"{self.root}/faulty")
        return ParquetStaging(self.spark, f"{self.root}/faulty")

    @cached_property
    def reloads(self) -> tuple[DataFrame, ParquetStaging, ParquetStaging]:
        """Three loads into one folder: all tables but two; then orders and
        products alone, with every second order; then sellers that break a rule,
        with the products again, so that nothing is published.  Returns what
        each load reported, a reader of the first load and one of the last."""
        root, staging = f"{self.root}/reloads", TestDataStaging(self.spark, self.sf_dir, dedup=False)
        write_csv(staging, f"{root}/csv-1", absent=("stg_geolocation", "stg_order_reviews"))
        rows = [(1, *r) for r in load_all(self.spark, f"{root}/csv-1", f"{root}/tables").collect()]
        first = ParquetStaging(self.spark, f"{root}/tables")
        staging.__dict__["stg_orders"] = staging.stg_orders.where(F.substring("order_id", 2, 18).cast("long") % 2 == 0)
        write_csv(staging, f"{root}/csv-2", absent=(), only=("stg_orders", "stg_products"))
        rows += [(2, *r) for r in load_all(self.spark, f"{root}/csv-2", f"{root}/tables").collect()]
        staging.__dict__["stg_sellers"] = staging.stg_sellers.withColumn("seller_city", F.lit(None).cast("string"))
        write_csv(staging, f"{root}/csv-3", absent=(), only=("stg_sellers", "stg_products"))
        try:
            load_all(self.spark, f"{root}/csv-3", f"{root}/tables")
        except LoadError:
            rows.append((3, "all", "failed", None, None, None))
        for k in (1, 2, 3):
            delete_path(self.spark, f"{root}/csv-{k}")
        report = self.spark.createDataFrame(rows, "load int, table_name string, status string, rows_in long, rows_dropped long, rows_out long")
        return report, first, ParquetStaging(self.spark, f"{root}/tables")

    @cached_property
    def exports(self) -> str:
        """The folder that the marts are exported to."""
        export_marts(self.marts.exports(), f"{self.root}/exports", order=Marts.EXPORT_ORDER)
        return f"{self.root}/exports"

    def release(self) -> None:
        """Delete all that this context wrote."""
        if "marts" in self.__dict__:
            self.marts.release()
        delete_path(self.spark, self.root)


def context(spark: SparkSession, sf_dir: str) -> Context:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CONTEXTS:
        _CONTEXTS[key] = Context(spark, sf_dir)
    return _CONTEXTS[key]


@atexit.register
def release_all() -> None:
    """Delete what the contexts of running sessions wrote, and the tables that
    results of the text operators read."""
    for c in _CONTEXTS.values():
        if c.spark.sparkContext._jsc is not None:
            c.release()
    _CONTEXTS.clear()
    spark = SparkSession.getActiveSession()
    if llm is not None and spark is not None and spark.sparkContext._jsc is not None:
        llm.release(spark)


def _staging(table: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return for_output(context(spark, sf_dir).raw.table(table))
    run.__name__ = table
    return run


def _dedup_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = TestDataStaging(spark, sf_dir).raw("lineitem").select(*LINEITEM_PK, *LINEITEM_ORDER)
    return keep_first(li, LINEITEM_PK, LINEITEM_ORDER)


def _dq_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    # primary keys are checked on the loaded rows before de-duplication
    return quality.pk_violations(TestDataStaging(spark, sf_dir, dedup=False).tables())


def _timestamps_coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every 13th order's approval time is malformed in the CSV copy
    return for_output(context(spark, sf_dir).loaded[1].table("stg_orders"))


def _ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(spark, sf_dir).loaded[0]


def _reload_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(spark, sf_dir).reloads[0]


def _reload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table as a reader of the first load sees them now, and as a
    new reader does."""
    _, first, last = context(spark, sf_dir).reloads
    out = []
    for name in STAGING:
        count = [t.table(name).agg(F.count(F.lit(1)).alias("n")) for t in (first, last)]
        out.append(count[0].select(F.lit(name).alias("table_name"), F.col("n").alias("rows_first"), count[1].scalar().alias("rows_now")))
    return reduce(DataFrame.unionByName, out)


def _reload_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the last good snapshot meet: items by status of the orders that
    the second load kept, with sellers that only the first one had."""
    last = context(spark, sf_dir).reloads[2]
    items = last.table("stg_order_items").join(last.table("stg_orders"), "order_id").join(last.table("stg_sellers"), "seller_id")
    return items.groupBy("order_status").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("order_id").alias("orders"))


def _over_faulty(fn: Callable[[dict[str, DataFrame]], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(context(spark, sf_dir).faulty.tables())


def _exported(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return for_output(with_position(load_mart(spark, context(spark, sf_dir).exports, name, cache=False)))
    return run


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: revenue by RFM segment over the smoke data."""
    return for_output(context(spark, SMOKE_DIR).marts.revenue_by_segment)


# Mart-level queries as functions of a Marts context (any staging source).
MART_QUERIES: dict[str, Callable[[Marts], DataFrame]] = {
    "segment_filter": lambda m: rfm.filter_segments(m.rfm_segment_summary, SEGMENT_FILTER),
    "segment_experience_filter": lambda m: rfm.filter_segments(m.segment_delivery_experience, SEGMENT_FILTER),
    "scatter_filter": lambda m: rfm.filter_segments(m.rfm_scatter, SEGMENT_FILTER),
    "rfm_scatter_500": lambda m: rfm.rfm_scatter(m.rfm_segments, 500),
    "kpi_labels": lambda m: present.kpi_labels(m.kpi_row),
    "state_labels": lambda m: present.state_labels(m.top_seller_states(20)),
    "retention_labels": lambda m: present.retention_labels(m.cohort_avg_6),
    "top_categories": lambda m: m.top_categories(15),
    "top_seller_states": lambda m: m.top_seller_states(20),
    "delivery_bands": lambda m: present.delivery_bands(m.delivery_vs_review),
    "state_bands": lambda m: present.state_bands(m.top_seller_states(20)),
    "retention_bands": lambda m: present.retention_bands(m.cohort_avg_6),
    "category_share": lambda m: present.category_share(m.top_categories(10)),
    "segment_display_table": lambda m: present.segment_display_table(m.rfm_segment_summary),
    "segment_labels": lambda m: present.segment_labels(m.rfm_segment_summary),
    "delivery_labels": lambda m: present.delivery_labels(m.delivery_vs_review),
    "cohort_labels": lambda m: present.cohort_labels(m.cohort_rates_6),
}
for _name in ("dim_customers", "dim_products", "fact_orders", "fact_order_items", "fact_reviews",
              "rfm_raw", "rfm_scores", "rfm_segments", "rfm_segment_summary", "repeat_rate",
              "rfm_scatter", "cohort_base", "customer_order_months", "cohort_retention_grid",
              "cohort_sizes", "cohort_retention_rates", "cohort_avg_retention", "cohort_matrix",
              "cohort_rates_6", "cohort_avg_6", "revenue_by_segment", "kpi_revenue_at_risk",
              "delivery_vs_review", "delivery_delay_by_seller_state",
              "segment_delivery_experience", "category_revenue_delivery", "late_rate_ratio",
              "totals", "kpi_row", "safe_vs_risk"):
    MART_QUERIES[_name] = (lambda n: lambda m: getattr(m, n))(_name)


def _over_testdata(fn: Callable[[Marts], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return for_output(fn(context(spark, sf_dir).marts))
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    qs: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "stg_customers": _staging("stg_customers"),
        "stg_orders": _staging("stg_orders"),
        "stg_order_items": _staging("stg_order_items"),
        "stg_order_payments": _staging("stg_order_payments"),
        "stg_order_reviews": _staging("stg_order_reviews"),
        "stg_products": _staging("stg_products"),
        "stg_sellers": _staging("stg_sellers"),
        "stg_geolocation": _staging("stg_geolocation"),
        "stg_category_translation": _staging("stg_product_category_translation"),
        "dedup_order_items": _dedup_order_items,
        "stg_timestamps_coerced": _timestamps_coerced,
        "ingest_report": _ingest_report,
        "reload_report": _reload_report,
        "reload_rows": _reload_rows,
        "reload_orders": _reload_orders,
        "dq_pk_violations": _dq_pk,
        "dq_null_counts": _over_faulty(lambda t: quality.null_counts(quality.column_violations(t))),
        "dq_domain_violations": _over_faulty(lambda t: quality.domain_violations(quality.column_violations(t))),
        "dq_orphans": _over_faulty(quality.orphans),
    }
    qs |= {f"export_{name}": _exported(name) for name in Marts.EXPORT_ORDER}
    for name, fn in MART_QUERIES.items():
        qs[name] = _over_testdata(fn)
    if llm is not None:
        qs.update(llm.QUERIES)
    if corpus_pipeline is not None:
        qs["pipeline"] = corpus_pipeline.run
    return qs


def oracle_sql() -> dict[str, str]:
    from oracles.duckdb_sql import oracle_sql as sqls
    out = dict(sqls())
    if llm is not None:
        out.update(llm.ORACLE_SQL)
    if corpus_pipeline is not None and corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
