import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from valuemarts.operators.ntile import NtileSpec, add_ntiles


def _builtin(df, col, k=5):
    w = Window.orderBy(F.col(col).asc_nulls_last(), F.col("id").asc())
    return {r["id"]: r["t"] for r in df.select("id", F.ntile(k).over(w).alias("t")).collect()}


def _ours(df, col, k=5, **opts):
    out = add_ntiles(df, [NtileSpec(col, "t", k)], "id", **opts)
    return {r["id"]: r["t"] for r in out.select("id", "t").collect()}


def _frame(spark, n, null_share=0.0, tie_share=0.0, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        u = rnd.random()
        if u < null_share:
            v = None
        elif u < null_share + tie_share:
            v = 1
        else:
            v = rnd.randint(-50, 10_000)
        rows.append((f"c{i:05d}", v))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "id string, x long").repartition(3)


@pytest.mark.parametrize("n", [1000, 996, 101, 4, 3, 1])
def test_matches_builtin_with_nulls(spark, n):
    df = _frame(spark, n, null_share=0.025)
    assert _ours(df, "x", rank_rows=20) == _builtin(df, "x")


def test_heavy_ties_spread_over_buckets(spark):
    df = _frame(spark, 1000, tie_share=0.97)
    ours = _ours(df, "x", rank_rows=20)
    assert ours == _builtin(df, "x")
    sizes = {}
    for t in ours.values():
        sizes[t] = sizes.get(t, 0) + 1
    assert max(sizes.values()) - min(sizes.values()) <= 1   # 200 per tile


def test_small_n_is_row_number(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2)], "id string, x long")
    assert _ours(df, "x") == {"b": 1, "c": 2, "a": 3}


def test_empty_input(spark):
    df = spark.createDataFrame([], "id string, x long")
    assert add_ntiles(df, [NtileSpec("x", "t")], "id").count() == 0


def test_decimal_and_several_specs(spark):
    rows = [(f"c{i:03d}", i % 7, None if i % 13 == 0 else i * 1.25) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, a long, b double") \
        .withColumn("b", F.col("b").cast("decimal(20,2)"))
    out = add_ntiles(df, [NtileSpec("a", "ta"), NtileSpec("b", "tb")], "id",
                     rank_rows=20)
    got = {r["id"]: (r["ta"], r["tb"]) for r in out.collect()}
    wa = Window.orderBy(F.col("a").asc_nulls_last(), "id")
    wb = Window.orderBy(F.col("b").asc_nulls_last(), "id")
    exp = {r["id"]: (r["ta"], r["tb"]) for r in df.select(
        "id", F.ntile(5).over(wa).alias("ta"), F.ntile(5).over(wb).alias("tb")).collect()}
    assert got == exp


def test_rows_are_not_moved(spark):
    df = _frame(spark, 2000)
    out = add_ntiles(df, [NtileSpec("x", "t")], "id", rank_rows=20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_ten_million_rows(spark):
    import time
    df = spark.range(10_000_000).selectExpr("id", "if(id % 10 < 6, 1, (id * 7919) % 100003) as x")
    out = add_ntiles(df, [NtileSpec("x", "t")], "id", materialize=False)
    began = time.time()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert time.time() - began < 10 and len(plan) < 20_000
    got = {r["t"]: (r["n"], r["hi"]) for r in out.groupBy("t").agg(F.count("*").alias("n"), F.max(F.struct("x", "id")).alias("hi")).collect()}
    low = out.groupBy("t").agg(F.min(F.struct("x", "id")).alias("lo")).collect()
    assert sorted(got) == [1, 2, 3, 4, 5] and {n for n, _ in got.values()} == {2_000_000}
    assert all(r["lo"] > got[r["t"] - 1][1] for r in low if r["t"] > 1)


def test_partition_independence(spark):
    df = _frame(spark, 700, null_share=0.05, tie_share=0.5)
    a = _ours(df, "x", rank_rows=20)
    b = _ours(df.repartition(11), "x", rank_rows=20)
    assert a == b
