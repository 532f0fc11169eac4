"""Line dedup against a plain count, and against DuckDB."""
import hashlib
from collections import defaultdict

import duckdb
import pytest

from valuemarts.llm import line_dedup
from valuemarts.llm.queries import ORACLE_SQL, op3_line_dedup


def brute(rows, min_sites):
    sites = defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(" \t\r") and s is not None:
                sites[x.strip(" \t\r")].add(s)
    out = []
    for i, t, _ in rows:
        gone = [x for x in (t or "").split("\n") if len(sites[x.strip(" \t\r")]) >= min_sites]
        left = [x for x in (t or "").split("\n") if len(sites[x.strip(" \t\r")]) < min_sites]
        if gone and any(x.strip(" \t\r") for x in left):
            t = "\n".join(left)
        else:
            gone = []
        out.append((i, t, len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_sites", [3, 10, 150])
def test_thresholds(spark, min_sites):
    rows = [(None, None, "a"), (1, "", "a"), (2, "\n\n", "b"), (3, "x" * 50000, None), (3, "x" * 50000, None)]
    for n in (1, 2, 3, 4, 9, 10, 11, 14, 16, 40, 140, 149, 150, 151, 170, 400):
        rows += [(n * 1000 + i, f"own {n} {i} with more of its own words\n \tseen on {n} sites\r\n\nlast {i} {n}", f"site{i}") for i in range(n)]
        rows += [(n, f"own text longer than the line\nseen on {n} sites", "site0")] * 2
    rows += [(7, "seen on 400 sites", f"site{i}") for i in range(3)]        # nothing but boilerplate: left whole
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as line", "2 as site", "'q' as n")
    got = line_dedup.clean(df, min_sites=min_sites)
    assert got.columns[:6] == df.columns
    assert sorted(((r.doc_id, r.text, r["__lines_removed"]) for r in got.collect()), key=str) == brute(rows, min_sites)


def test_boilerplate_goes_from_pages_that_are_mostly_boilerplate(spark):
    line = "one long line that stands on every site and makes up most of each page"
    rows = [(i, f"{line}\nown {i}", f"site{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.text for r in line_dedup.clean(df).collect()} == {f"own {i}" for i in range(12)}
    assert {r.text for r in line_dedup.clean(df, max_removed=0.5).collect()} == {t for _, t, _ in rows}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_dedup.clean(df).count() == 0


def test_query_against_duckdb(spark):
    sf = "/root/testdata/sf0.01"
    got = op3_line_dedup(spark, sf).select("doc_id", "lines_removed", "chars_removed", "text_sha256").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(f"SELECT doc_id, lines_removed, chars_removed, text_sha256 FROM ({ORACLE_SQL['op3_line_dedup']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r.lines_removed for r in got) > 20 and hashlib.sha256(b"").hexdigest() not in {r.text_sha256 for r in got}
