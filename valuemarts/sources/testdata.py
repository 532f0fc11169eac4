"""Fill the nine staging tables from the driver's TPC-H-like test tables.

The reference ships no data.  This mapping (FIXTURES.md §2) derives staging
rows from ``orders``, ``customer``, ``nation``, ``lineitem``, ``part``,
``supplier`` and ``events`` with integer arithmetic and exact casts only, so
the same rows can be produced by an independent SQL oracle.  Every table is a
lazy DataFrame over the parquet files: Catalyst prunes columns and pushes
filters into the scans of whichever marts use them.

Only ``stg_order_items`` can repeat its key (``lineitem`` repeats
``(l_orderkey, l_linenumber)``), so only it — and the payments derived from it
— pass through keep-first de-duplication; every other key is unique by
construction here.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedup import keep_first, keep_first_dealt
from ..operators.skew import is_spread
from ..session import default_buckets, delete_path, read_bucketed, stored_bytes, write_bucketed
from .ingest import as_csv_text, read_version, write_version
from .snapshots import Snapshots
from .spec import STAGING

# Order status codes of the test data → the reference's statuses.
STATUS_MAP = {"F": "delivered", "O": "shipped", "P": "canceled"}

# Keep-first order for duplicated lineitem keys.
LINEITEM_PK = ("l_orderkey", "l_linenumber")
LINEITEM_ORDER = ("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus")


#: columns of the kept lineitem rows that items and payments are made of
LINEITEM_KEPT = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_returnflag")


def _key(prefix: str, c) -> F.Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def _order_id(li: DataFrame) -> F.Column:
    """The order id of lineitem rows, which a written copy of them holds."""
    return F.col("order_id") if "order_id" in li.columns else _key("o", F.col("l_orderkey")).alias("order_id")


def _zip(c) -> F.Column:
    return F.lpad(c.cast("string"), 5, "0")


def _state(name, key) -> F.Column:
    """Two letters: the nation's first, then a small one for its key (not "NA", a null token)."""
    return F.concat(F.substring(name, 1, 1), F.char(F.lit(97) + key))


def _category() -> F.Column:
    return F.concat_ws(" ", "p_type", "p_brand")


def _typed(df: DataFrame, table: str) -> DataFrame:
    """Project onto the declared columns, casting only those whose type differs."""
    spec = STAGING[table]
    have = {f.name: f.dataType for f in df.schema.fields}
    if all(have.get(c.name) == c.dtype for c in spec.columns) and \
            list(have) == spec.column_names:
        return df
    return df.select(*[F.col(c.name) if have.get(c.name) == c.dtype
                       else F.col(c.name).cast(c.dtype).alias(c.name) for c in spec.columns])


class TestDataStaging:
    """Lazy staging tables over ``{sf_dir}/{table}.parquet``."""

    __test__ = False  # not a pytest test class

    def __init__(self, spark: SparkSession, sf_dir: str, dedup: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        # dedup=False gives the rows as loaded, before keep-first (for PK checks)
        self.dedup = dedup

        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    # -- the nine staging tables --------------------------------------------

    @cached_property
    def stg_customers(self) -> DataFrame:
        o, c, n = self.raw("orders"), self.raw("customer"), self.raw("nation")
        df = (o.join(c, o.o_custkey == c.c_custkey)
               .join(n, c.c_nationkey == n.n_nationkey)
               .select(_key("o", o.o_orderkey).alias("customer_id"),
                       _key("c", o.o_custkey).alias("customer_unique_id"),
                       _zip(c.c_nationkey).alias("customer_zip_code_prefix"),
                       c.c_mktsegment.alias("customer_city"),
                       _state(n.n_name, c.c_nationkey).alias("customer_state")))
        return _typed(df, "stg_customers")

    @cached_property
    def stg_orders(self) -> DataFrame:
        o = self.raw("orders")
        k = F.col("o_orderkey")
        day = F.to_date("o_orderdate")
        status = F.col("o_orderstatus")
        mapped = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_MAP.items()
                                                        for x in kv]), status), status)
        delivered = F.when((status == "F") & (k % 97 != 0),
                           F.date_add(day, (F.lit(4) + (k * 7) % 31).cast("int")))
        df = o.select(
            _key("o", k).alias("order_id"),
            _key("o", k).alias("customer_id"),
            mapped.alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            F.col("o_orderdate").alias("order_approved_at"),
            F.date_sub(delivered, 1).cast("timestamp_ntz").alias("order_delivered_carrier_date"),
            delivered.cast("timestamp_ntz").alias("order_delivered_customer_date"),
            F.date_add(day, (F.lit(18) + k % 11).cast("int")).cast("timestamp_ntz")
             .alias("order_estimated_delivery_date"))
        return _typed(df, "stg_orders")

    @cached_property
    def lineitem_first(self) -> DataFrame:
        li = self.raw("lineitem").select(*LINEITEM_PK, *LINEITEM_ORDER)
        return keep_first(li, LINEITEM_PK, LINEITEM_ORDER) if self.dedup else li

    @cached_property
    def stg_order_items(self) -> DataFrame:
        li = self.lineitem_first
        df = li.select(
            _order_id(li),
            F.col("l_linenumber").alias("order_item_id"),
            _key("p", F.col("l_partkey")).alias("product_id"),
            _key("s", F.col("l_suppkey")).alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            F.col("l_extendedprice").cast("decimal(10,2)").alias("price"),
            F.col("l_quantity").cast("decimal(10,2)").alias("freight_value"))
        return _typed(df, "stg_order_items")

    @cached_property
    def stg_order_payments(self) -> DataFrame:
        li = self.lineitem_first
        df = li.select(
            _order_id(li),
            F.col("l_linenumber").alias("payment_sequential"),
            F.col("l_returnflag").alias("payment_type"),
            F.lit(1).alias("payment_installments"),
            F.col("l_extendedprice").cast("decimal(10,2)").alias("payment_value"))
        return _typed(df, "stg_order_payments")

    @cached_property
    def stg_order_reviews(self) -> DataFrame:
        e = self.raw("events")
        eid = F.col("event_id")
        order_key = F.when(eid % 10 == 9, eid - 1).otherwise(eid)
        df = e.select(
            _key("r", eid).alias("review_id"),
            _key("o", order_key).alias("order_id"),
            (F.lit(1) + F.floor("value").cast("int") % 5).alias("review_score"),
            F.col("event_type").alias("review_comment_title"),
            F.col("props").alias("review_comment_message"),
            F.col("ts").alias("review_creation_date"),
            F.col("ts").alias("review_answer_timestamp"))
        return _typed(df, "stg_order_reviews")

    @cached_property
    def stg_products(self) -> DataFrame:
        p = self.raw("part")
        size = F.col("p_size")
        # every 101st product has no row: its items get no category
        df = p.where(F.col("p_partkey") % 101 != 0).select(
            _key("p", F.col("p_partkey")).alias("product_id"),
            F.when(F.col("p_partkey") % 50 != 0, _category()).alias("product_category_name"),
            F.length("p_name").alias("product_name_lenght"),
            F.length("p_brand").alias("product_description_lenght"),
            (size % 5).alias("product_photos_qty"),
            size.alias("product_weight_g"),
            size.alias("product_length_cm"),
            (size % 7).alias("product_height_cm"),
            (size % 11).alias("product_width_cm"))
        return _typed(df, "stg_products")

    @cached_property
    def stg_sellers(self) -> DataFrame:
        s, n = self.raw("supplier"), self.raw("nation")
        df = (s.join(n, s.s_nationkey == n.n_nationkey)
               .select(_key("s", s.s_suppkey).alias("seller_id"),
                       _zip(s.s_nationkey).alias("seller_zip_code_prefix"),
                       s.s_name.alias("seller_city"),
                       _state(n.n_name, s.s_nationkey).alias("seller_state")))
        return _typed(df, "stg_sellers")

    @cached_property
    def stg_geolocation(self) -> DataFrame:
        n = self.raw("nation")
        df = n.select(_zip(F.col("n_nationkey")).alias("geolocation_zip_code_prefix"),
                      F.col("n_nationkey").cast("decimal(10,6)").alias("geolocation_lat"),
                      F.col("n_nationkey").cast("decimal(10,6)").alias("geolocation_lng"),
                      F.col("n_name").alias("geolocation_city"),
                      _state(F.col("n_name"), F.col("n_nationkey")).alias("geolocation_state"))
        return _typed(df, "stg_geolocation")

    @cached_property
    def stg_product_category_translation(self) -> DataFrame:
        p = self.raw("part")
        df = (p.where(~F.col("p_type").startswith("PROMO"))
               .select(_category().alias("product_category_name"),
                       F.lower(_category()).alias("product_category_name_english"))
               .distinct())
        return _typed(df, "stg_product_category_translation")

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in STAGING}


class FaultyStaging:
    """The same tables with faults set by rules on the keys, for the quality
    checks: NULLs in NOT NULL columns, texts beyond their limit and children
    without a parent."""

    def __init__(self, staging: TestDataStaging):
        self.staging, self.spark = staging, staging.spark

    def tables(self) -> dict[str, DataFrame]:
        out = dict(self.staging.tables())
        number = F.substring("order_id", 2, 18).cast("long")
        out["stg_customers"] = out["stg_customers"].withColumns({
            "customer_city": F.when(F.substring("customer_id", 2, 18).cast("long") % 37 != 0, F.col("customer_city")),
            "customer_state": F.when(F.substring("customer_id", 2, 18).cast("long") % 41 == 0, F.lit("too long"))
                               .otherwise(F.col("customer_state"))})
        out["stg_orders"] = out["stg_orders"].withColumn(
            "customer_id", F.when(number % 43 == 0, F.concat(F.lit("x"), F.col("customer_id"))).otherwise(F.col("customer_id")))
        out["stg_order_items"] = out["stg_order_items"].withColumns({
            "price": F.when(number % 47 != 0, F.col("price")),
            "seller_id": F.when(number % 53 == 0, F.lit("s-none")).otherwise(F.col("seller_id"))})
        out["stg_sellers"] = out["stg_sellers"].withColumn(
            "seller_zip_code_prefix", F.when(F.substring("seller_id", 2, 18).cast("long") % 7 == 0, F.lit("00000-00000")).otherwise(F.col("seller_zip_code_prefix")))
        return out


#: the CSV copies are compressed: they are the most that a load's input writes
CSV_CODEC = "snappy"


def write_csv(staging: TestDataStaging, folder: str, absent: tuple[str, ...] = ("stg_geolocation",),
              only: tuple[str, ...] | None = None) -> None:
    """The tables as CSV files for the loader: item and payment keys repeat as
    in the input, every 13th order has a malformed approval time, and the
    ``absent`` tables (or all but ``only``) have no file."""
    for name, spec in STAGING.items():
        if name in absent or only is not None and name not in only:
            continue
        text = as_csv_text(staging.table(name))
        if name == "stg_orders":
            bad = F.substring("order_id", 2, 18).cast("long") % 13 == 0
            text = text.withColumn("order_approved_at", F.when(bad, F.lit("13/2017 noon")).otherwise(F.col("order_approved_at")))
        (text.write.option("header", True).option("escape", '"').option("quoteAll", True)
         .option("compression", CSV_CODEC).csv(f"{folder}/{spec.csv_stem}.csv"))


def write_lineitem_first(source: TestDataStaging, path: str, count: int) -> None:
    """Write the de-duplicated lineitem rows in ``count`` buckets by order id, and
    let ``source`` derive items and payments from that copy.

    The rows are dealt by order id once, before de-duplication; where an order
    holds a large share of them, after it.  The id is text, so it is made of the
    key where it is needed and not shuffled beside it."""
    rows, order_id = source.raw("lineitem").select(*LINEITEM_PK, *LINEITEM_ORDER), _key("o", F.col("l_orderkey"))
    dealt = source.dedup and is_spread(rows, "l_orderkey")
    kept = (keep_first_dealt(rows, ("order_id", "l_linenumber"), LINEITEM_ORDER, "order_id", count, order_id) if dealt
            else source.lineitem_first.withColumn("order_id", order_id)).select("order_id", *LINEITEM_KEPT)
    write_bucketed(kept, path, "order_id", count, arranged=dealt)
    source.__dict__["lineitem_first"] = read_bucketed(source.spark, path, kept.schema, "order_id", count)
    for cached in ("stg_order_items", "stg_order_payments"):
        source.__dict__.pop(cached, None)


def staging_buckets(source: TestDataStaging) -> int:
    """The bucket count of a folder's tables follows the size of lineitem."""
    return default_buckets(source.spark, stored_bytes(source.spark, f"{source.sf_dir}/lineitem.parquet"))


class WrittenStaging:
    """The staging tables of a test-data folder for marts: those that are bucketed
    by order id are written when first asked for, so a mart pays for the tables
    it reads.  Items and payments are projections of one written copy of the
    de-duplicated lineitem rows; the others are read through the mapping."""

    def __init__(self, source: TestDataStaging, out_dir: str):
        self.source, self.spark, self.out_dir = source, source.spark, out_dir.rstrip("/")   # the source is rewired
        self.buckets = staging_buckets(source)
        self._tables: dict[str, DataFrame] = {}
        self._lineitem_written = False
        self._lock = RLock()

    def _get(self, name: str) -> DataFrame:
        if name in ("stg_order_items", "stg_order_payments"):
            if not self._lineitem_written:
                write_lineitem_first(self.source, f"{self.out_dir}/_lineitem_first", self.buckets)
                self._lineitem_written = True
        elif STAGING[name].bucket_by:
            return read_version(self.spark, name, write_version(self.source.table(name), self.out_dir, name, self.buckets))
        return self.source.table(name)

    def table(self, name: str) -> DataFrame:
        with self._lock:
            if name not in self._tables:
                self._tables[name] = self._get(name)
            return self._tables[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in STAGING:
            return self.table(name)
        raise AttributeError(name)

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in STAGING}


def write_staging(staging: TestDataStaging | FaultyStaging, out_dir: str, parallel_jobs: int = 4) -> None:
    """Write the nine staging tables once (the loader's job) and commit them as
    one snapshot; marts then read them through ``ingest.ParquetStaging`` instead
    of re-deriving them.

    The de-duplicated lineitem rows feed two tables, so they are written first
    (:func:`write_lineitem_first`) and both are derived from that copy, which is
    then deleted; both keep its layout.  The nine writes are independent jobs and
    are submitted from a few driver threads so they share the cluster instead of
    queueing.
    """
    out = out_dir.rstrip("/")
    spark = staging.spark
    source = staging if isinstance(staging, TestDataStaging) else staging.staging
    count, first = staging_buckets(source), f"{out}/_lineitem_first"
    write_lineitem_first(source, first, count)
    arranged = {"stg_order_items", "stg_order_payments"}

    def write(name: str, df: DataFrame) -> tuple[str, dict]:
        return name, write_version(df, out, name, count, name in arranged)
    with ThreadPoolExecutor(max_workers=parallel_jobs) as pool:
        entries = dict(pool.map(lambda item: write(*item), staging.tables().items()))
    snapshots = Snapshots(spark, out)
    snapshots.commit(snapshots.current(), entries)
    delete_path(spark, first)
