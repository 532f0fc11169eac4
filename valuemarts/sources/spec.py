"""Declared shape of the nine staging tables.

Types, primary keys, NOT NULL columns and the length/range limits of the
reference's staging DDL, plus the CSV file stem each table is loaded from and
the columns the loader coerces to timestamps.  All of this is configuration:
the checks and the loader in this package read it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

S, I, TS = T.StringType(), T.IntegerType(), T.TimestampNTZType()
SMALL = T.ShortType()
MONEY = T.DecimalType(10, 2)
COORD = T.DecimalType(10, 6)


@dataclass(frozen=True)
class Column:
    name: str
    dtype: T.DataType
    nullable: bool = True
    max_length: int | None = None  # VARCHAR(n) / CHAR(n)


@dataclass(frozen=True)
class TableSpec:
    name: str
    csv_stem: str
    columns: tuple[Column, ...]
    pk: tuple[str, ...] = ()
    timestamp_cols: tuple[str, ...] = ()
    # free text that may hold line breaks; such a CSV cannot be split, so only
    # tables that need it read with multiLine
    multiline: bool = False
    # tables that meet on this column are written in buckets of it
    bucket_by: str | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.dtype, c.nullable) for c in self.columns])

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def not_null(self) -> list[str]:
        return [c.name for c in self.columns if not c.nullable]

    def keep_first_order(self) -> list[str]:
        return [c for c in self.column_names if c not in self.pk]


def _c(name, dtype, nullable=True, max_length=None):
    return Column(name, dtype, nullable, max_length)


# Table names, CSV stems, column names, types, keys and limits
# of the reference's staging layer.
STAGING = {
    "stg_customers": TableSpec(
        "stg_customers", "olist_customers_dataset",
        (_c("customer_id", S, False, 50), _c("customer_unique_id", S, False, 50),
         _c("customer_zip_code_prefix", S, False, 10), _c("customer_city", S, False, 100),
         _c("customer_state", S, False, 2)),
        pk=("customer_id",)),
    "stg_orders": TableSpec(
        "stg_orders", "olist_orders_dataset",
        (_c("order_id", S, False, 50), _c("customer_id", S, False, 50),
         _c("order_status", S, False, 20), _c("order_purchase_timestamp", TS),
         _c("order_approved_at", TS), _c("order_delivered_carrier_date", TS),
         _c("order_delivered_customer_date", TS), _c("order_estimated_delivery_date", TS)),
        pk=("order_id",), bucket_by="order_id",
        timestamp_cols=("order_purchase_timestamp", "order_approved_at",
                        "order_delivered_carrier_date", "order_delivered_customer_date",
                        "order_estimated_delivery_date")),
    "stg_order_items": TableSpec(
        "stg_order_items", "olist_order_items_dataset",
        (_c("order_id", S, False, 50), _c("order_item_id", I, False),
         _c("product_id", S, False, 50), _c("seller_id", S, False, 50),
         _c("shipping_limit_date", TS), _c("price", MONEY, False),
         _c("freight_value", MONEY, False)),
        pk=("order_id", "order_item_id"), bucket_by="order_id",
        timestamp_cols=("shipping_limit_date",)),
    "stg_order_payments": TableSpec(
        "stg_order_payments", "olist_order_payments_dataset",
        (_c("order_id", S, False, 50), _c("payment_sequential", I, False),
         _c("payment_type", S, False, 30), _c("payment_installments", I, False),
         _c("payment_value", MONEY, False)),
        pk=("order_id", "payment_sequential"), bucket_by="order_id"),
    "stg_order_reviews": TableSpec(
        "stg_order_reviews", "olist_order_reviews_dataset",
        (_c("review_id", S, False, 50), _c("order_id", S, False, 50),
         _c("review_score", SMALL, False), _c("review_comment_title", S),
         _c("review_comment_message", S), _c("review_creation_date", TS),
         _c("review_answer_timestamp", TS)),
        pk=("review_id",), bucket_by="order_id",
        timestamp_cols=("review_creation_date", "review_answer_timestamp"),
        multiline=True),
    "stg_products": TableSpec(
        "stg_products", "olist_products_dataset",
        (_c("product_id", S, False, 50), _c("product_category_name", S, True, 100),
         _c("product_name_lenght", I), _c("product_description_lenght", I),
         _c("product_photos_qty", I), _c("product_weight_g", I),
         _c("product_length_cm", I), _c("product_height_cm", I), _c("product_width_cm", I)),
        pk=("product_id",)),
    "stg_sellers": TableSpec(
        "stg_sellers", "olist_sellers_dataset",
        (_c("seller_id", S, False, 50), _c("seller_zip_code_prefix", S, False, 10),
         _c("seller_city", S, False, 100), _c("seller_state", S, False, 2)),
        pk=("seller_id",)),
    "stg_geolocation": TableSpec(
        "stg_geolocation", "olist_geolocation_dataset",
        (_c("geolocation_zip_code_prefix", S, False, 10), _c("geolocation_lat", COORD, False),
         _c("geolocation_lng", COORD, False), _c("geolocation_city", S, False, 100),
         _c("geolocation_state", S, False, 2))),
    "stg_product_category_translation": TableSpec(
        "stg_product_category_translation", "product_category_name_translation",
        (_c("product_category_name", S, False, 100),
         _c("product_category_name_english", S, False, 100)),
        pk=("product_category_name",)),
}

# Announced (not declared) foreign keys: child table, child column → parent table, parent column.
FOREIGN_KEYS = (
    ("stg_orders", "customer_id", "stg_customers", "customer_id"),
    ("stg_order_items", "order_id", "stg_orders", "order_id"),
    ("stg_order_items", "product_id", "stg_products", "product_id"),
    ("stg_order_items", "seller_id", "stg_sellers", "seller_id"),
    ("stg_order_payments", "order_id", "stg_orders", "order_id"),
    ("stg_order_reviews", "order_id", "stg_orders", "order_id"),
)


def decimal_limit(dtype: T.DataType) -> float | None:
    """Largest magnitude (exclusive) a NUMERIC(p, s) column can hold."""
    if isinstance(dtype, T.DecimalType):
        return float(10 ** (dtype.precision - dtype.scale))
    return None
