"""Staging tables written as marts need them: results against the plain mapping,
and what is written."""

import os
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from valuemarts.operators.dedup import keep_first, keep_first_dealt
from valuemarts.operators.skew import is_spread
from valuemarts.plans.marts import Marts
from valuemarts.sources.spec import STAGING
from valuemarts.sources.testdata import TestDataStaging, WrittenStaging

DAY = datetime(2018, 1, 1)


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def write_tables(spark, folder, hot=0):
    """Small tables of the driver's schema: repeated line keys, a repeated and a
    missing order, an unknown product and seller; ``hot`` more lines of one order."""
    orders = [(k, k % 7, "FOP"[k % 3], 1.0, DAY + timedelta(days=k), "1") for k in [*range(400), 12]]
    lines = [(None if k % 411 == 410 else k % 400, k % 13, k % 6, k % 3, float(k % 5), 1.25 * (k % 9), 0.0, 0.0, "ANR"[k % 3], "O", DAY + timedelta(days=k % 4))
             for k in [*range(1600), *range(0, 1600, 4)]]
    lines += [(7, k % 13, 0, k, 1.0, 2.5, 0.0, 0.0, "A", "O", DAY) for k in range(hot)]
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "customer": ([(k, f"c{k}", k % 2, 0.0, "m") for k in range(6)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "nation": ([(0, "PERU", 0), (1, "CHAD", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                            "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
        "part": ([(k, f"n{k}", f"b{k % 3}", "PROMO A" if k % 4 == 0 else "B", k, 1.0) for k in range(1, 11)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(k, f"s{k}", k % 2, 0.0) for k in range(5)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "events": ([(k, DAY, k, "t", float(k), "p") for k in range(40)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("hot", [0, 400])
def test_written_tables_equal_the_mapping(spark, tmp_path, hot):
    folder = write_tables(spark, tmp_path / "in", hot)
    plain, written = TestDataStaging(spark, folder), WrittenStaging(TestDataStaging(spark, folder), str(tmp_path / "out"))
    assert is_spread(plain.raw("lineitem"), "l_orderkey") == (hot == 0)
    for name in STAGING:
        assert written.table(name).columns == plain.table(name).columns
        assert [f.dataType for f in written.table(name).schema] == [f.dataType for f in plain.table(name).schema]
        assert rows_of(written.table(name)) == rows_of(plain.table(name)), name


def test_a_mart_writes_only_the_tables_it_reads(spark, tmp_path):
    written = WrittenStaging(TestDataStaging(spark, write_tables(spark, tmp_path / "in")), str(tmp_path / "out"))
    m = Marts(written)
    scores = rows_of(m.rfm_scores)
    assert sorted(os.listdir(tmp_path / "out")) == ["_lineitem_first", "stg_orders"]      # no reviews, no second copy of the items
    lazy = Marts(TestDataStaging(spark, written.source.sf_dir), materialize=False)
    assert scores == rows_of(lazy.rfm_scores)
    for mart in ("category_revenue_delivery", "delivery_delay_by_seller_state", "fact_order_items"):
        assert rows_of(getattr(m, mart)) == rows_of(getattr(lazy, mart)), mart
    assert sorted(os.listdir(tmp_path / "out")) == ["_lineitem_first", "stg_order_reviews", "stg_orders"]
    m.release()


def test_written_items_meet_orders_without_a_shuffle(spark, tmp_path):
    written = WrittenStaging(TestDataStaging(spark, write_tables(spark, tmp_path / "in")), str(tmp_path / "out"))
    per_order = written.stg_order_payments.groupBy("order_id").agg(F.sum("payment_value").alias("v"))
    per_order.collect()
    assert "Exchange" not in per_order._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_rows_are_dealt_by_a_value_they_do_not_hold(spark):
    df = spark.range(900, numPartitions=3).selectExpr("if(id % 17 = 0, null, id % 200) as k", "cast(id % 3 as int) as n", "id % 11 as x")
    value = F.concat(F.lit("o"), F.col("k").cast("string"))
    got = keep_first_dealt(df, ("o", "n"), ("x",), "o", 5, value)
    want = keep_first(df.withColumn("o", value), ["o", "n"], ["x", "k"])
    assert rows_of(got.select("o", "n", "x", "k")) == rows_of(want.select("o", "n", "x", "k"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange ", plan)) == 1 and got.rdd.getNumPartitions() == 5
