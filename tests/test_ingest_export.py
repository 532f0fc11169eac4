"""CSV ingest → staging Parquet → marts → exports, in a fresh temporary folder."""

import csv
import os
import tempfile

from valuemarts.plans.marts import Marts
from valuemarts.sources.export import export_csv, export_marts, load_mart
from valuemarts.sources.ingest import ParquetStaging, load_all
from valuemarts.sources.spec import STAGING
from valuemarts.plans import present


def _write(folder, table, header, rows):
    stem = STAGING[table].csv_stem
    with open(os.path.join(folder, f"{stem}.csv"), "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


def _source(folder):
    _write(folder, "stg_customers",
           ["customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city",
            "customer_state"],
           [["k1", "u1", "01037", "sao paulo", "SP"], ["k2", "u1", "01037", "sao paulo", "SP"],
            ["k3", "u2", "20000", "rio", "RJ"]])
    _write(folder, "stg_orders",
           ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
            "order_delivered_carrier_date", "order_delivered_customer_date",
            "order_estimated_delivery_date"],
           [["o1", "k1", "delivered", "2017-10-02 10:56:33", "n/a", "", "2017-10-10 21:25:13",
             "2017-10-18 00:00:00"],
            ["o2", "k2", "delivered", "2018-01-05 09:00:00", "", "", "2018-01-20 10:00:00",
             "2018-01-15 00:00:00"],
            ["o3", "k3", "canceled", "2018-02-01 08:00:00", "", "", "", "2018-02-20 00:00:00"]])
    _write(folder, "stg_order_payments",
           ["order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"],
           [["o1", "1", "credit_card", "1", "18.12"], ["o1", "2", "voucher", "1", "2.00"],
            ["o2", "1", "boleto", "1", "141.46"], ["o2", "1", "boleto", "1", "999.99"]])
    # a duplicated review id; the comment holds a newline and quotes
    _write(folder, "stg_order_reviews",
           ["review_id", "order_id", "review_score", "review_comment_title", "review_comment_message",
            "review_creation_date", "review_answer_timestamp"],
           [["r1", "o1", "4", "", 'ok\nsaid "fine"', "2017-10-11 00:00:00", "2017-10-12 03:43:48"],
            ["r1", "o1", "1", "", "dup", "2017-10-11 00:00:00", "2017-10-12 03:43:48"],
            ["r2", "o2", "5", "", "", "2018-01-21 00:00:00", "bad"]])
    # stg_order_items, products, sellers, geolocation and translation files are absent


def test_load_report_and_types(spark):
    src = tempfile.mkdtemp(prefix="vm-src-", dir="/tmp")
    out = tempfile.mkdtemp(prefix="vm-stg-", dir="/tmp")
    _source(src)
    report = {r["table_name"]: r for r in load_all(spark, src, out).collect()}
    assert report["stg_order_items"]["status"] == "skipped"
    assert report["stg_order_reviews"]["rows_in"] == 3
    assert report["stg_order_reviews"]["rows_dropped"] == 1
    assert report["stg_order_payments"]["rows_out"] == 3

    st = ParquetStaging(spark, out)
    cust = {r["customer_id"]: r for r in st.table("stg_customers").collect()}
    assert cust["k1"]["customer_zip_code_prefix"] == "01037"          # leading zero kept
    orders = {r["order_id"]: r for r in st.table("stg_orders").collect()}
    assert orders["o1"]["order_approved_at"] is None                  # 'n/a' → NULL
    assert orders["o1"]["order_delivered_customer_date"].day == 10
    reviews = {r["review_id"]: r for r in st.table("stg_order_reviews").collect()}
    assert reviews["r1"]["review_score"] == 4                          # first in file order
    assert reviews["r1"]["review_comment_message"] == 'ok\nsaid "fine"'  # multi-line, quoted
    assert reviews["r2"]["review_answer_timestamp"] is None
    pay = {(r["order_id"], r["payment_sequential"]): r for r in st.table("stg_order_payments").collect()}
    assert str(pay[("o2", 1)]["payment_value"]) == "141.46"


def test_marts_export_round_trip(spark):
    src = tempfile.mkdtemp(prefix="vm-src-", dir="/tmp")
    out = tempfile.mkdtemp(prefix="vm-stg-", dir="/tmp")
    marts_dir = tempfile.mkdtemp(prefix="vm-marts-", dir="/tmp")
    _source(src)
    load_all(spark, src, out)

    m = Marts(ParquetStaging(spark, out))
    log = {r["mart"]: r["rows"] for r in export_marts(m.exports(), marts_dir).collect()}
    assert log["totals"] == 1 and log["kpi_revenue_at_risk"] == 1
    totals = load_mart(spark, marts_dir, "totals").collect()[0]
    assert totals["total_orders"] == 2 and totals["total_customers"] == 1
    assert totals["total_revenue"] == 162.0                            # 20.12 + 141.46 → 0 places

    csv_dir = os.path.join(marts_dir, "segments_csv")
    export_csv(present.segment_display_table(m.rfm_segment_summary), csv_dir)
    back = spark.read.option("header", True).csv(csv_dir)
    assert "Revenue (R$)" in back.columns and back.count() == m.rfm_segment_summary.count()


def test_keep_first_follows_file_order_across_splits(spark):
    src = tempfile.mkdtemp(prefix="vm-src-", dir="/tmp")
    out = tempfile.mkdtemp(prefix="vm-stg-", dir="/tmp")
    rows = [[f"o{i}", "1", "card", "1", f"{i}.00"] for i in range(3000)]
    rows[2500] = ["o7", "1", "late_copy", "1", "999.00"]      # duplicate key, later in the file
    rows[40] = ["o2900", "1", "early_copy", "1", "1.23"]       # duplicate key, earlier in the file
    _write(src, "stg_order_payments",
           ["order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"],
           rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")   # many splits, several tasks
    try:
        load_all(spark, src, out)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    pay = {r["order_id"]: r for r in ParquetStaging(spark, out).table("stg_order_payments").collect()}
    assert pay["o7"]["payment_type"] == "card"
    assert pay["o2900"]["payment_type"] == "early_copy"
    assert len(pay) == 2998
