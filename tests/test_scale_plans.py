"""Joins on hot keys, bucketed order tables, keep-first, month bits, hash top-k:
results against plain forms, and the shape of their plans."""

import hashlib
import random
import re
from datetime import date
from statistics import median

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from valuemarts.operators.dedup import keep_by_position, keep_first
from valuemarts.operators.skew import heavy_keys, join_dimension
from valuemarts.operators.topk import first_by_hash, hash_prefix, hash_threshold
from valuemarts.plans import cohort, rfm
from valuemarts.session import materialize

SF = "/root/testdata/sf0.001"


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def final(plan):
    return plan.split("== Initial Plan ==")[0]


@pytest.fixture
def no_broadcast(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.enabled") if spark.conf.get(k, None) is not None}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k, v in old.items():
        spark.conf.set(k, v)


# -- hot keys --------------------------------------------------------------------

def hot_items(spark, n=20000, parts=8):
    return (spark.range(n, numPartitions=parts)
            .select(F.concat(F.lit("o"), "id").alias("order_id"),
                    F.when(F.col("id") % 5 < 2, "p_hot").when(F.col("id") % 997 == 5, F.lit(None)).otherwise(F.concat(F.lit("p"), F.col("id") % 3001)).alias("product_id")))


def test_heavy_keys_are_found(spark):
    assert heavy_keys(hot_items(spark), "product_id") == ["p_hot"]
    assert heavy_keys(hot_items(spark).where("product_id <> 'p_hot'"), "product_id") == []
    assert heavy_keys(hot_items(spark).limit(0), "product_id") == []
    assert heavy_keys(spark.range(500).selectExpr("concat('k', id % 60) as k"), "k", share=1 / 128) == sorted(f"k{i}" for i in range(60))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_a_split_join_gives_the_plain_join(spark, how):
    items = hot_items(spark)
    dim = spark.range(0, 3001, 2).selectExpr("concat('p', id) as product_id", "id as category").union(spark.createDataFrame([("p_hot", -1)], "product_id string, category long"))
    for d in (dim, dim.where("product_id <> 'p_hot'")):
        want = items.join(d, "product_id", how).select("order_id", "product_id", "category")
        got = join_dimension(items, d, "product_id", ["p_hot", "absent"], how).select("order_id", "product_id", "category")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_a_product_with_two_fifths_of_the_items_is_no_hot_task(no_broadcast):
    spark = no_broadcast
    spark.conf.set("spark.sql.adaptive.enabled", "false")          # no skew handling by AQE
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    items = hot_items(spark, 40000)
    dim = spark.range(3001).selectExpr("concat('p', id) as product_id", "id as category").union(spark.createDataFrame([("p_hot", -1)], "product_id string, category long"))

    def per_task(df):
        return sorted(r["n"] for r in df.groupBy(F.spark_partition_id().alias("t")).agg(F.count(F.lit(1)).alias("n")).collect())
    plain = per_task(items.join(dim, "product_id", "left"))
    split = per_task(join_dimension(items, dim, "product_id", heavy_keys(items, "product_id")))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert plain[-1] > 2 * median(plain) and split[-1] <= 2 * median(split) and sum(split) == 40000


# -- buckets ---------------------------------------------------------------------

def test_bucketed_tables_meet_without_a_shuffle(no_broadcast):
    spark = no_broadcast
    a = spark.range(500).selectExpr("concat('o', id) as order_id", "id as x", "cast(id as decimal(10,2)) as m", "cast(null as timestamp_ntz) as t")
    b = spark.range(1000).selectExpr("concat('o', id % 600) as order_id", "id as y")
    x, y = (materialize(d, "bucket-test", "order_id")[0] for d in (a, b))
    joined = x.join(y, "order_id").groupBy("order_id").agg(F.sum("y").alias("s"), F.max("m").alias("m"))
    plan = final(executed(joined))
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    want = a.join(b, "order_id").groupBy("order_id").agg(F.sum("y").alias("s"), F.max("m").alias("m"))
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, want.collect()))
    assert x.schema["m"].dataType.simpleString() == "decimal(10,2)" and x.schema["t"].dataType.simpleString() == "timestamp_ntz"
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("valuemarts_")]


@pytest.mark.parametrize("mart", ["delivery_delay_by_seller_state", "category_revenue_delivery", "delivery_vs_review", "fact_reviews",
                                  "segment_delivery_experience"])
def test_marts_shuffle_nothing_by_order(no_broadcast, mart):
    marts = entry.context(no_broadcast, SF).marts.prepare()
    plan = final(executed(getattr(marts, mart)))
    assert not re.search(r"Exchange hashpartitioning\([^)]*order_id", plan)


def test_order_weights_are_written_without_a_shuffle(no_broadcast):
    marts = entry.context(no_broadcast, SF).marts
    from valuemarts.plans import risk
    plan = final(executed(risk.order_weights(marts.fact_orders, marts.stg("stg_order_reviews"))))
    assert "Exchange" not in plan


def test_order_edges_are_checked_without_a_shuffle(no_broadcast):
    from valuemarts.operators import quality
    staging = entry.context(no_broadcast, SF).staging
    orders = {t: staging.table(t) for t in ("stg_orders", "stg_order_payments")}
    plan = final(executed(quality.orphans(orders)))
    assert not re.search(r"Exchange hashpartitioning\((k|order_id)", plan)


# -- keep-first ------------------------------------------------------------------

def _dups(spark, seed=0):
    r = random.Random(seed)
    rows = [(r.randint(0, 60) if r.random() < 0.7 else 1000 + i, r.choice([None, "a", "b"]), r.randint(0, 5) or None, f"t{r.randint(0, 3)}") for i in range(900)]
    rows += [(7, "a", 0, "hot")] * 500
    return rows, spark.createDataFrame(rows, "k int, p string, x int, t string").repartition(6)


def test_keep_first_equals_sorting(spark):
    rows, df = _dups(spark)
    best = {}
    for k, p, x, t in rows:
        order = (x is not None, x or 0, t)
        if (k, p) not in best or order < best[k, p][0]:
            best[k, p] = (order, (k, p, x, t))
    got = keep_first(df, ["k", "p"], ["x"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((v for _, v in best.values()), key=repr)
    plan = final(executed(keep_first(df.select("k", "p", "x"), ["k", "p"], ["x"])))
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_keep_by_position_equals_the_first_row(spark):
    rows, _ = _dups(spark, 1)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, k int, p string, x int, t string").repartition(6)
    first = {}
    for i, (k, p, x, t) in enumerate(rows):
        first.setdefault((k, p), (i, k, p, x, t))
    got = keep_by_position(df, ["k", "p"], "n")
    assert sorted(map(tuple, got.collect())) == sorted(first.values())
    assert "SortAggregate" not in final(executed(got))


def test_rows_with_their_own_key_are_not_moved(no_broadcast):
    """No repeated key: the rows pass a join with nothing, unsorted by keep-first."""
    spark = no_broadcast
    df = spark.range(1000).selectExpr("id as k", "id * 2 as x")
    assert sorted(r.x for r in keep_first(df, ["k"]).collect()) == [2 * i for i in range(1000)]
    assert "SortAggregate" not in final(executed(keep_first(df, ["k"])))


def test_dedup_order_items_has_no_sort_aggregate(spark):
    plan = final(executed(entry.queries()["dedup_order_items"](spark, SF)))
    assert "SortAggregate" not in plan


# -- cohorts ---------------------------------------------------------------------

def test_month_bits_over_long_spans(spark):
    r = random.Random(4)
    rows, grid = [], {}
    for c in range(120):
        months = sorted({r.choice([0, 1, 62, 63, 64, 126, 127, 200, r.randint(0, 200)]) for _ in range(r.randint(1, 6))})
        for m in months:
            rows.append((f"u{c}", date(2001 + m // 12, m % 12 + 1, 1)))
            key = (date(2001 + months[0] // 12, months[0] % 12 + 1, 1), m - months[0])
            grid[key] = grid.get(key, 0) + 1
    rows.append(("u_none", None))
    months = spark.createDataFrame(rows, f"{cohort.ID} string, order_month date").selectExpr(
        "*", "cast(order_month as timestamp_ntz) as first_order_date", "cast(order_month as timestamp_ntz) as last_order_date", "1L as frequency", "cast(1 as decimal(10,2)) as monetary")
    span = cohort.month_span(months)
    assert span.words == 4 and span.first == date(2001, 1, 1)
    customers = rfm.customers_of(months, span)
    got = {(x.cohort_month, x.period_number): x.retained_customers for x in cohort.cohort_retention_grid(customers, span).collect()}
    assert got == grid
    assert cohort.month_span(months.where("false")) is None and cohort.cohort_retention_grid(customers, None).count() == 0


def test_the_grid_shuffles_patterns_and_sorts_no_customer(no_broadcast):
    marts = entry.context(no_broadcast, SF).marts.prepare()
    plan = final(executed(marts.cohort_retention_grid))
    assert "Window" not in plan and "Sort " not in plan
    assert not re.search(r"Exchange hashpartitioning\(customer_unique_id", plan)


# -- top-k by hash ---------------------------------------------------------------

@pytest.mark.parametrize("n,size", [(0, 5), (30, 50), (4000, 100), (50000, 600)])
def test_first_by_hash(spark, n, size):
    df = spark.range(n, numPartitions=8).selectExpr("concat('u', id) as id", "id as x")
    want = sorted((hashlib.md5(f"u{i}".encode()).hexdigest(), f"u{i}") for i in range(n))[:size]
    assert [r.id for r in first_by_hash(df, "id", size).collect()] == [i for _, i in want]
    bound = hash_threshold(df, "id", size)
    if n > 2 * size:
        assert size <= df.where(hash_prefix("id") < bound).count() <= 2 * size


def test_equal_ids_need_a_larger_threshold(spark):
    """All rows share one id: the threshold grows until it holds enough rows."""
    df = spark.range(1000).selectExpr("'same' as id", "id as x")
    assert first_by_hash(df, "id", 10).count() == 10
