"""Rows dealt once by a key column, bucket counts that follow the input, and
dimension joins that sort no large side."""

import re

import pytest
from pyspark.sql import functions as F

from valuemarts.operators.dedup import keep_first, keep_first_dealt
from valuemarts.operators.skew import is_spread, join_dimension
from valuemarts.session import BUCKET_BYTES, default_buckets, stored_bytes
from valuemarts.sources import ingest
from valuemarts.sources.spec import STAGING


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_first_rows_are_the_same_and_move_once(no_broadcast):
    df = (no_broadcast.range(3000, numPartitions=5)
          .selectExpr("if(id % 17 = 0, null, concat('o', id % 700)) as o", "cast(id % 3 as int) as k", "if(id % 5 = 0, null, id % 11) as x", "id % 2 as y"))
    got = keep_first_dealt(df, ("o", "k"), ("x", "y"), "o", 6)
    want = keep_first(df, ["o", "k"], ["x", "y"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert len(re.findall(r"\bExchange ", executed(got))) == 1
    assert got.rdd.getNumPartitions() == 6


def test_a_heavy_value_or_null_is_not_spread(spark):
    even = spark.range(2000).selectExpr("concat('o', id % 1000) as o")
    assert is_spread(even, "o") and is_spread(even.limit(0), "o")
    assert not is_spread(even.union(even.limit(100).select(F.lit("o1"))), "o")
    assert not is_spread(even.union(even.limit(100).select(F.lit(None).cast("string"))), "o")


def test_buckets_follow_the_input(spark, tmp_path):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert default_buckets(spark) == default_buckets(spark, BUCKET_BYTES) == least
    assert default_buckets(spark, 360 * BUCKET_BYTES + 1) == 361
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "part").write_bytes(b"12345")
    assert stored_bytes(spark, str(tmp_path / "x")) == 5 and stored_bytes(spark, str(tmp_path / "none")) == 0


def test_a_larger_csv_is_loaded_in_more_buckets(spark, tmp_path, monkeypatch):
    rows = [f"o{i % 300},1,p{i},s{i % 7},2018-01-02 03:04:05,{i}.50,1.00" for i in range(600)]
    head = "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value"
    (tmp_path / "olist_order_items_dataset.csv").write_text("\n".join([head, *rows]) + "\n")
    monkeypatch.setattr(ingest, "CSV_SHARE", 4 << 10)
    out = str(tmp_path / "out")
    r = ingest.load_table(spark, str(tmp_path), out, STAGING["stg_order_items"])
    assert (r.rows_in, r.rows_out) == (600, 300)
    staging = ingest.ParquetStaging(spark, out)
    size = stored_bytes(spark, str(tmp_path / "olist_order_items_dataset.csv"))
    assert staging.buckets == -(-size // (4 << 10)) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {x.order_id: x.product_id for x in staging.table("stg_order_items").collect()}
    assert got == {f"o{i}": f"p{i}" for i in range(300)}


def test_a_dimension_join_does_not_sort_the_large_side(no_broadcast):
    items = no_broadcast.range(5000, numPartitions=4).selectExpr("id", "concat('p', id % 900) as product_id")
    dim = no_broadcast.range(0, 900, 2).selectExpr("concat('p', id) as product_id", "id as category")
    for heavy in ([], ["p4"]):
        got = join_dimension(items, dim, "product_id", heavy)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, items.join(dim, "product_id", "left").collect()), key=repr)
        assert "Sort " not in executed(got)
