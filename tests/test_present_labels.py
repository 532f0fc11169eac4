"""Bands and labels at their edges, ordered exports, and the fan-out weights
of the oracle held against the literal joins."""

import duckdb
import pytest

from oracles import duckdb_sql
from valuemarts.plans import present
from valuemarts.sources.export import export_marts, load_mart, ordered, with_position

from conftest import SF0001


def test_every_band(spark):
    d = spark.createDataFrame([(1, 0.01, 10.01), (2, 0.0, 10.0), (3, -3.0, 5.01), (4, None, 5.0)],
                              "review_score int, avg_delivery_delay_days double, late_delivery_pct double")
    got = {r.review_score: (r.delay_band, r.late_band) for r in present.delivery_bands(d).collect()}
    assert got == {1: ("late", "high"), 2: ("early", "medium"), 3: ("early", "medium"), 4: ("early", "low")}
    s = spark.createDataFrame([("a", 0.01, 4.0), ("b", 0.0, 4.0), ("c", -4.99, 4.0), ("d", -5.0, None)],
                              "seller_state string, avg_delay_days double, avg_review_score double")
    assert {r.seller_state: r.delay_band for r in present.state_bands(s).collect()} == {"a": "late", "b": "near", "c": "near", "d": "early"}
    assert {r.seller_state: r.score_label for r in present.state_labels(s).collect()}["d"] == "★ nan"
    c = spark.createDataFrame([(0, 100.0), (1, 3.01), (2, 3.0)], "period_number int, avg_retention_pct double")
    assert [r.retention_band for r in present.retention_bands(c).orderBy("period_number").collect()] == ["acquisition", "above_3pct", "at_most_3pct"]
    assert [r.retention_label for r in present.retention_labels(c).orderBy("period_number").collect()] == ["100.0%", "3.0%", "3.0%"]


def test_kpi_labels(spark):
    k = spark.createDataFrame([(12345, 1234567.0, 999, 12.35, 98765.5, 3.1)],
                              "total_orders long, total_revenue double, total_customers long, revenue_at_risk_pct double, revenue_at_risk double, repeat_pct double")
    assert tuple(present.kpi_labels(k).head()) == ("12,345", "R$ 1,234,567", "999", "12.4%", "R$ 98,766", "3.1%")


def test_export_keeps_the_order(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 7) if i % 5 else None) for i in range(200)], "k int, v double").repartition(9)
    export_marts({"m": ordered(df, "-v", "k")}, str(tmp_path))
    rows = with_position(load_mart(spark, str(tmp_path), "m", cache=False)).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, 201))
    assert [r.k for r in rows] == [r[0] for r in sorted(((i, float(i % 7) if i % 5 else None) for i in range(200)), key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))]


LITERAL = {
    "delivery_delay_by_seller_state": """
        SELECT seller_state, COUNT(DISTINCT o.order_id), ROUND(AVG(o.delivery_delay_days), 2), COUNT(*) FILTER (o.delivery_delay_days > 0) * 100.0 / COUNT(*),
               AVG(review_score)
        FROM delivered o JOIN stg_order_items USING (order_id) JOIN stg_sellers USING (seller_id) LEFT JOIN stg_order_reviews USING (order_id)
        WHERE o.delivery_delay_days IS NOT NULL GROUP BY 1""",
    "segment_delivery_experience": """
        SELECT rfm_segment, COUNT(DISTINCT customer_unique_id), SUM(monetary), AVG(delivery_delay_days), AVG(review_score),
               COUNT(*) FILTER (delivery_delay_days > 0) * 100.0 / COUNT(*)
        FROM rfm_segments JOIN delivered USING (customer_unique_id) LEFT JOIN stg_order_reviews USING (order_id) GROUP BY 1""",
    "category_revenue_delivery": """
        SELECT category_en, COUNT(DISTINCT order_id), SUM(revenue), AVG(delivery_delay_days), AVG(review_score)
        FROM fact_order_items JOIN delivered USING (order_id) LEFT JOIN stg_order_reviews USING (order_id) GROUP BY 1""",
}


@pytest.mark.parametrize("view", LITERAL)
def test_oracle_multiplicities_equal_the_literal_joins(view):
    con = duckdb.connect()
    for t in "nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    ours = {r[0]: r[1:] for r in con.sql(duckdb_sql.q(f"SELECT * FROM {view}")).fetchall()}
    literal = {r[0]: r[1:] for r in con.sql(duckdb_sql.q(LITERAL[view])).fetchall()}
    assert ours.keys() == literal.keys() and len(ours) > 3
    for k, row in ours.items():
        assert row[0] == literal[k][0]
        for a, b in zip(row[1:], literal[k][1:]):
            assert (a is None) == (b is None) and (a is None or abs(float(a) - float(b)) <= 0.0051)
