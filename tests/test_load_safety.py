"""Loads that must fail, and what a failed load leaves."""

import csv
import os

import pytest

from valuemarts.sources.ingest import LoadError, ParquetStaging, load_all, load_table, manifest
from valuemarts.sources.spec import STAGING

SELLERS = ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"]
GEO = ["geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng", "geolocation_city", "geolocation_state"]


def _write(folder, table, header, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{STAGING[table].csv_stem}.csv", "w", newline="") as f:
        csv.writer(f).writerows([header, *rows])


def _sellers(n, start=0):
    return [[f"s{i}", "01000", "city", "SP"] for i in range(start, start + n)]


def test_misspelt_key_header_fails(spark, tmp_path):
    _write(tmp_path / "src", "stg_sellers", ["sellerid", *SELLERS[1:]], _sellers(5))
    with pytest.raises(LoadError, match="stg_sellers.*no column seller_id"):
        load_all(spark, str(tmp_path / "src"), str(tmp_path / "out"))


def test_null_keys_and_null_values_fail(spark, tmp_path):
    rows = _sellers(5)
    rows[1][0] = rows[3][0] = ""
    rows[2][2] = "NA"
    _write(tmp_path / "src", "stg_sellers", SELLERS, rows)
    with pytest.raises(LoadError, match="2 rows NULL in seller_id.*1 rows NULL in seller_city"):
        load_table(spark, str(tmp_path / "src"), str(tmp_path / "out"), STAGING["stg_sellers"])


def test_too_long_text_fails_unless_allowed(spark, tmp_path):
    rows = _sellers(3)
    rows[0][3] = "São"
    _write(tmp_path / "src", "stg_sellers", SELLERS, rows)
    args = (spark, str(tmp_path / "src"), str(tmp_path / "out"), STAGING["stg_sellers"])
    with pytest.raises(LoadError, match="1 rows longer than 2 in seller_state"):
        load_table(*args)
    assert load_table(*args, enforce_lengths=False).rows_out == 3


@pytest.mark.parametrize("table,header,good,bad", [
    ("stg_sellers", SELLERS, _sellers(4), [["", "1", "c", "SP"]]),
    ("stg_geolocation", GEO, [["1", "1.5", "2.5", "c", "SP"]] * 4, [["1", "not a number", "2.5", "c", "SP"]]),
])
def test_failed_reload_keeps_the_table(spark, tmp_path, table, header, good, bad):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    _write(src, table, header, good)
    load_table(spark, src, out, STAGING[table])
    _write(src, table, header, good + bad)
    with pytest.raises(Exception):
        load_table(spark, src, out, STAGING[table])
    assert ParquetStaging(spark, out).table(table).count() == 4
    _write(src, table, header, good[:2])
    load_table(spark, src, out, STAGING[table])
    assert ParquetStaging(spark, out).table(table).count() == 2
    versions = [d for d in os.listdir(f"{out}/{table}") if d.startswith("v-")]
    assert manifest(spark, out, table)["path"].rsplit("/", 1)[1] in versions


def test_only_a_skipped_table_reads_as_empty(spark, tmp_path):
    with pytest.raises(LoadError, match="never loaded"):
        ParquetStaging(spark, str(tmp_path / "nowhere")).table("stg_orders")
    _write(tmp_path / "src", "stg_sellers", SELLERS, _sellers(2))
    load_all(spark, str(tmp_path / "src"), str(tmp_path / "out"))
    st = ParquetStaging(spark, str(tmp_path / "out"))
    assert st.table("stg_orders").count() == 0 and st.table("stg_sellers").count() == 2


def test_absent_nullable_column_and_null_tokens(spark, tmp_path):
    _write(tmp_path / "src", "stg_products", ["product_id", "product_category_name", "product_weight_g"],
           [["p1", "toys", "5"], ["p2", "N/A", "nan"], ["p3", "null", ""]])
    load_table(spark, str(tmp_path / "src"), str(tmp_path / "out"), STAGING["stg_products"])
    rows = {r.product_id: r for r in ParquetStaging(spark, str(tmp_path / "out")).table("stg_products").collect()}
    assert (rows["p1"].product_category_name, rows["p1"].product_weight_g) == ("toys", 5)
    assert all(rows[p].product_category_name is None and rows[p].product_weight_g is None for p in ("p2", "p3"))
    assert rows["p1"].product_photos_qty is None


def test_folder_of_part_files(spark, tmp_path):
    # a folder named like the file is read in parallel, also where a single file could not be split
    folder = tmp_path / "src" / f"{STAGING['stg_order_reviews'].csv_stem}.csv"
    os.makedirs(folder)
    head = ["review_id", "order_id", "review_score", "review_comment_title", "review_comment_message", "review_creation_date", "review_answer_timestamp"]
    for k in range(3):
        with open(folder / f"part-{k}.csv", "w", newline="") as f:
            csv.writer(f).writerows([head, *[[f"r{k}{i}", "o1", "5", "", "two\nlines", "", ""] for i in range(4)]])
    assert load_table(spark, str(tmp_path / "src"), str(tmp_path / "out"), STAGING["stg_order_reviews"]).rows_out == 12
