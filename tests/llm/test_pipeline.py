"""The pipeline against a brute-force version, stage by stage."""
import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline as cp
from valuemarts.llm import langid
from valuemarts.llm.common import split_of
from valuemarts.llm.queries import ORACLE_SQL
from tests.llm.test_op7_near_dup import brute as near_brute

SF = "/root/testdata/sf0.001"
LIB = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, each stage reading its predecessor's Parquet."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, f in cp.STAGES:
        docs = spark.createDataFrame(out[-1], docs.schema)
        got = f(spark, docs, SF)
        out.append(got.collect())
        if f is not cp.STAGES[-1][1]:
            assert got.schema.names == docs.schema.names
            docs = got
    return out


def test_stages_named():
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    assert __spark_entry__.queries()["pipeline"] is cp.run and "pipeline" not in __spark_entry__.oracle_sql()


def test_language_stage(spark, stages):
    docs = spark.createDataFrame(stages[0])
    model = langid.fit(docs, split_of("doc_id", 4) != 2)
    lang, score = model.predict([r.text or "" for r in stages[0]])
    want = [r for r, x, s in zip(stages[0], lang, score) if x != "und" and s >= cp.MIN_LANGUAGE_SCORE]
    assert sorted(stages[1]) == sorted(want) and len(want) >= 0.95 * len(stages[0])


def test_line_stage(stages):
    import pandas as pd
    documents = pd.DataFrame([r.asDict() for r in stages[1]])
    want = duckdb.sql(f"SELECT doc_id, text_sha256 FROM ({ORACLE_SQL['op3_line_dedup']})").fetchall()
    assert len(documents) and sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in stages[2]) == sorted(want)


def test_near_stage(stages):
    kept = {i for i, _, _, k in near_brute([(r.doc_id, r.text) for r in stages[2]], cp.SHINGLE) if k}
    assert sorted(stages[3]) == sorted(r for r in stages[2] if r.doc_id in kept)


def test_decontamination_stage(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r.doc_id for r in stages[3] if any(i in r.text for i in items)}
    left = {r.doc_id for r in stages[4]}
    assert not bad & left and len({r.doc_id for r in stages[3]} - bad - left) <= 2


def test_bpe_stage_and_run(spark, stages):
    text = {r.doc_id: r.text for r in stages[4]}
    for r in stages[5]:
        ids = LIB.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, stages[5]))


def test_edges(spark):
    long = "the cat sat on the mat and then it went away to sleep"
    rows = [(1, long, "en", 1.5), (1, long, "en", 1.5), (1, long + " again", "en", 1.5), (None, long, None, None), (2, long.upper(), "en", 2.5), (3, None, "en", 1.0), (4, "", "en", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, count double").selectExpr("*", "'s' as source", "1 as n")
    for name, f in cp.STAGES:
        docs = spark.createDataFrame(f(spark, docs, SF).collect(), f(spark, docs, SF).schema)
        if name == "near_dedup":
            assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "None"]
    assert docs.count() == 2
    empty = docs.sparkSession.createDataFrame([], "doc_id long, text string, lang string, source string")
    for _, f in cp.STAGES:
        assert f(spark, empty, SF).count() == 0


def test_decontaminate_decides_per_row(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 60").head().text
    clean = "nothing of the sort stands here"
    rows = [(None, clean), (None, f"here: {item} yes"), (7, clean), (7, item), (None, None), (8, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as source")
    got = cp.decontaminate(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(None, clean), (7, clean), (None, None)], key=str)


def test_boilerplate_goes_from_short_pages(spark):
    line = "a line that stands on every one of the sites and is longer than the page's own words"
    rows = [(i, f"{line}\nown {i}\n{line}", f"site{i}") for i in range(12)] + [(20, f"{line}\n\n {line}", "site1"), (21, None, "site1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in cp.dedup_lines(spark, docs, SF).collect()}
    assert got == {**{i: f"own {i}" for i in range(12)}, 20: rows[12][1], 21: None}


def test_last_stage_carries_ids_and_columns(spark):
    docs = spark.createDataFrame([(1, "some text", "en", 1.5), (None, None, None, None)], "doc_id long, text string, lang string, count double")
    got = cp.tokens(spark, docs, SF)
    assert got.columns == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    rows = {r.doc_id: r for r in got.collect()}
    assert tuple(rows[1])[:4] == (1, "some text", "en", 1.5) and rows[1].ids == LIB.encode("some text", add_special_tokens=False).ids
    assert tuple(rows[None])[:4] == (None, None, None, None) and rows[None].ids == []


def test_near_dedup_decides_per_text(spark):
    a, b, c = ("the first of three texts that have nothing at all in common with each other", "something else stands in this one and it is not like the others",
               "a third matter is treated here at some length so that it has enough words")
    rows = [(1, a), (1, b), (2, c), (5, c + " again"), (5, None), (5, ""), (9, b), (9, b), (7, a + " and b"), (7, "only here are these words to be found, in the last one"), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as source")
    got = cp.near_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    have = [(r.doc_id, r.text) for r in got.collect()]
    groups = [{(1, a), (7, a + " and b")}, {(1, b), (9, b)}, {(2, c), (5, c + " again")}, {(5, None), (5, "")}, {(7, rows[9][1])}, {(None, a)}]
    assert len(have) == len(groups) and all(sum(x in g for x in have) == 1 for g in groups)
    three = spark.createDataFrame([(1, a), (1, b), (2, c)], "doc_id long, text string").selectExpr("*", "'s' as source")
    assert cp.near_dedup(spark, three, SF).count() == 3


def test_run_restores_the_sessions_batch_size(spark):
    before = spark.conf.get(cp.ARROW_ROWS, None)
    seen, plain = [], list(cp.STAGES)
    try:
        for named, within in ((None, "1000"), ("77", "77")):
            spark.conf.unset(cp.ARROW_ROWS) if named is None else spark.conf.set(cp.ARROW_ROWS, named)
            cp.STAGES[:] = [plain[0], ("look", lambda spark, docs, sf_dir: seen.append(spark.conf.get(cp.ARROW_ROWS, None)) or docs)]
            cp.run(spark, "/root/testdata/sf0.001")
            assert (seen.pop(), spark.conf.get(cp.ARROW_ROWS, None)) == (within, named)
    finally:
        cp.STAGES[:] = plain
        spark.conf.unset(cp.ARROW_ROWS) if before is None else spark.conf.set(cp.ARROW_ROWS, before)
