from decimal import Decimal

from pyspark.sql import functions as F

from valuemarts.functions.exact import cents, ratio_round


def _rr(spark, pairs, k):
    df = spark.createDataFrame(pairs, "num long, den long")
    return [r[0] for r in df.select(ratio_round("num", "den", k)).collect()]


def test_half_away_from_zero(spark):
    # 0.125 and -0.125 → 0.13 / -0.13; 7/8 → 0.88, -7/8 → -0.88
    assert _rr(spark, [(1, 8), (-1, 8), (7, 8), (-7, 8)], 2) == [0.13, -0.13, 0.88, -0.88]


def test_no_double_rounding(spark):
    # 1.005 is 1.00499999... as a double; exact ratio rounds up
    assert _rr(spark, [(1005, 1000), (2675, 1000)], 2) == [1.01, 2.68]


def test_zero_and_null(spark):
    out = _rr(spark, [(5, 0), (None, 3), (0, 3), (-1, 1000)], 2)
    assert out[0] is None and out[1] is None
    assert out[2] == 0.0 and str(out[3]) == "0.0"   # rounds to +0.0, not -0.0


def test_large_values_exact(spark):
    big = 10 ** 17 + 1
    assert _rr(spark, [(big, 2)], 0) == [float(big // 2 + 1)]


def test_cents(spark):
    df = spark.createDataFrame([(Decimal("12.34"),), (Decimal("-0.05"),)], "m decimal(10,2)")
    assert [int(r[0]) for r in df.select(cents(F.col("m"))).collect()] == [1234, -5]


def test_label_helpers(spark):
    from valuemarts.functions.format import one_place_text, thousands, whole_units
    df = spark.createDataFrame([(0.25,), (-0.25,), (1234.56,), (-0.04,), (12.0,)], "x double")
    got = [tuple(r) for r in df.select(one_place_text("x", signed=True), one_place_text("x"),
                                       thousands(whole_units("x"))).collect()]
    assert got == [("+0.3", "0.3", "0"), ("-0.3", "-0.3", "0"), ("+1234.6", "1234.6", "1,235"),
                   ("+0.0", "0.0", "0"), ("+12.0", "12.0", "12")]
