"""Loads and exports as sets of tables: what a reader sees when files are
absent, when a writer dies, and when two writers meet."""

import csv
import os

import pytest

from valuemarts.session import delete_path
from valuemarts.sources import export, ingest
from valuemarts.sources.export import ExportError, export_csv, export_marts, load_mart, release_marts, with_position
from valuemarts.sources.ingest import ParquetStaging, load_all, load_table, manifest
from valuemarts.sources.snapshots import SnapshotConflict, Snapshots
from valuemarts.sources.spec import STAGING

SELLERS = ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"]
TRANSLATION = ["product_category_name", "product_category_name_english"]


def _write(folder, table, header, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{STAGING[table].csv_stem}.csv", "w", newline="") as f:
        csv.writer(f).writerows([header, *rows])


def _sellers(folder, n):
    _write(folder, "stg_sellers", SELLERS, [[f"s{i}", "01000", "city", "SP"] for i in range(n)])


def _translation(folder, n):
    _write(folder, "stg_product_category_translation", TRANSLATION, [[f"c{i}", f"e{i}"] for i in range(n)])


def _rows(spark, out, *tables):
    return [ParquetStaging(spark, out).table(t).count() for t in tables]


BOTH = ("stg_sellers", "stg_product_category_translation")


def test_an_absent_file_keeps_the_rows(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    _sellers(src, 2)
    _translation(src, 3)
    load_all(spark, src, out)
    os.remove(f"{src}/{STAGING['stg_sellers'].csv_stem}.csv")
    _translation(src, 5)
    report = {r.table_name: r for r in load_all(spark, src, out).collect()}
    assert report["stg_sellers"].status == "skipped" and report["stg_sellers"].rows_out is None
    assert _rows(spark, out, *BOTH, "stg_orders") == [2, 5, 0]
    load_table(spark, src, out, STAGING["stg_sellers"])
    assert _rows(spark, out, *BOTH) == [2, 5]


def test_a_load_that_dies_between_two_tables_leaves_the_old_set(spark, tmp_path, monkeypatch):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    _sellers(src, 2)
    _translation(src, 3)
    load_all(spark, src, out)
    _sellers(src, 4)
    _translation(src, 4)
    stage = ingest.stage_table

    def dies(spark_, data, out_, spec, lengths=True):
        if spec.name == "stg_product_category_translation":
            raise RuntimeError("lost")
        return stage(spark_, data, out_, spec, lengths)
    monkeypatch.setattr(ingest, "stage_table", dies)
    with pytest.raises(RuntimeError, match="lost"):
        load_all(spark, src, out, parallel_jobs=1)
    assert _rows(spark, out, *BOTH) == [2, 3]
    assert len([d for d in os.listdir(f"{out}/stg_sellers") if d.startswith("v-")]) == 1      # what it wrote is gone
    monkeypatch.setattr(ingest, "stage_table", stage)
    load_all(spark, src, out)
    assert _rows(spark, out, *BOTH) == [4, 4]


def test_readers_keep_their_snapshot_until_the_next_but_one(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    _sellers(src, 1)
    _translation(src, 1)
    load_all(spark, src, out)
    reader = ParquetStaging(spark, out)
    _sellers(src, 7)
    _translation(src, 8)
    load_all(spark, src, out)
    assert [reader.table(t).count() for t in BOTH] == [1, 1] and _rows(spark, out, *BOTH) == [7, 8]
    first = reader.snapshot["tables"]["stg_sellers"]["path"]
    assert os.path.isdir(first.removeprefix("file:"))
    load_all(spark, src, out)
    assert not os.path.exists(first.removeprefix("file:"))
    assert len(os.listdir(f"{out}/_snapshots")) >= 2 and Snapshots(spark, out).current()["number"] == 3


def test_of_two_writers_the_second_fails(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    before = s.current()
    s.commit(before, {"a": {"path": s.new_version("a")}})
    with pytest.raises(SnapshotConflict):
        s.commit(before, {"b": {"path": s.new_version("b")}})
    assert set(s.current()["tables"]) == {"a"}
    assert [f for f in os.listdir(tmp_path / "_snapshots") if f.endswith(".part")] == []


def test_vacuum_removes_what_no_snapshot_names(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    _sellers(src, 2)
    load_all(spark, src, out)
    os.makedirs(f"{out}/stg_sellers/v-dead")
    s = Snapshots(spark, out)
    assert s.vacuum() == [] and s.vacuum(older_than_hours=0) == ["stg_sellers/v-dead"]
    assert _rows(spark, out, "stg_sellers") == [2] and manifest(spark, out, "stg_sellers")["rows_out"] == 2


def test_a_failed_export_leaves_the_former_one(spark, tmp_path):
    out = str(tmp_path / "marts")
    good = {"a": spark.range(3).orderBy("id"), "b": spark.range(4)}
    assert {r.mart: r.rows for r in export_marts(good, out, order={"a": ("id",)}).collect()} == {"a": 3, "b": 4}
    bad = {"a": spark.range(30), "b": spark.range(4).selectExpr("raise_error('no') as x")}
    with pytest.raises(Exception):
        export_marts(bad, out)
    assert load_mart(spark, out, "a", verify=True).count() == 3 and load_mart(spark, out, "b", cache=False).count() == 4
    entry = Snapshots(spark, out).current()["tables"]["a"]
    assert entry["order"] == ["id"] and entry["rows"] == 3
    assert [len([d for d in os.listdir(f"{out}/{m}") if d.startswith("v-")]) for m in "ab"] == [1, 1]
    assert [r.position for r in with_position(load_mart(spark, out, "a", cache=False)).collect()] == [1, 2, 3]
    with pytest.raises(ExportError, match="never exported"):
        load_mart(spark, out, "c")


def test_a_cached_mart_follows_a_new_export(spark, tmp_path):
    out = str(tmp_path / "marts")
    export_marts({"a": spark.range(3)}, out)
    old = load_mart(spark, out, "a")
    assert old.count() == 3 and old.is_cached and load_mart(spark, out, "a") is old
    export_marts({"a": spark.range(5)}, out)
    new = load_mart(spark, out, "a")
    assert new.count() == 5 and not old.is_cached and new.is_cached
    release_marts(out)
    assert not new.is_cached and not [k for k in export._CACHED if k[0] == out]


def test_changed_files_are_noticed(spark, tmp_path):
    out = str(tmp_path / "marts")
    export_marts({"a": spark.range(3)}, out)
    path = Snapshots(spark, out).current()["tables"]["a"]["path"]
    spark.range(1, 4).write.mode("overwrite").parquet(path)
    with pytest.raises(ExportError, match="snapshot says 3 rows"):
        load_mart(spark, out, "a", cache=False, verify=True)


def test_csv_export_replaces_only_when_whole(spark, tmp_path):
    path = str(tmp_path / "x")
    export_csv(spark.range(2), path)
    with pytest.raises(Exception):
        export_csv(spark.range(2).selectExpr("raise_error('no') as x"), path)
    assert spark.read.option("header", True).csv(path).count() == 2
    export_csv(spark.range(9), path)
    assert spark.read.option("header", True).csv(path).count() == 9 and os.listdir(tmp_path) == ["x"]
    delete_path(spark, path)
