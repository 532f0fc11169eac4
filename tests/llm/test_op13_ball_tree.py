"""Ranked search against plain scoring of all pairs; bounds against all documents."""
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from valuemarts.llm import ball_tree
from valuemarts.llm.queries import OP13_SQL, op13_ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, c in tf if c)
    total = sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in tf:
            if i is None or not c:
                continue
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                found.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def made(seed, n=400, vocabulary=120):
    r = random.Random(seed)
    word = ["".join(r.choice("abcdefé9") for _ in range(r.randint(1, 6))) for _ in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    docs = [(i, r.choice(["", " ", "-", ". "]).join(r.choices(word, weights, k=r.choice([0, 1, 3, 20, 60])))) for i in range(n)]
    docs = [(i, " ".join(r.choices(word, weights, k=r.choice([0, 1, 3, 20, 60])))) if i % 3 else d for i, d in docs for d in [(i, d)]]
    items = [(j, " ".join(r.choices(word, weights, k=r.choice([1, 4, 30])))) for j in range(25)]
    return docs, items


def run(spark, docs, items, k=10, parts=3):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ball_tree.rank(d, q, k).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_scoring(spark, seed, monkeypatch):
    docs, items = made(seed)
    monkeypatch.setattr(ball_tree, "BATCH_ITEMS", 10)
    assert run(spark, docs, items) == brute(docs, items)


def test_edges(spark):
    docs = [(None, "cat dog"), (1, None), (2, ""), (3, "!!"), (4, "Cat"), (4, "cat"), (-5, "CAT"), (6, "ÉCOLE école cat"), (7, "dog " * 5000), (8, "a1b2-a1b2")]
    docs += [(100 + i, "cat") for i in range(30)]
    items = [(1, "cat"), (1, "cat cat"), (None, "dog"), (3, None), (4, ""), (5, "nothing here"), (6, "école Cat"), (7, "a1b2 x\x00y")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []
    assert run(spark, docs, items, k=100) == brute(docs, items, 100)


def test_bounds_hold_for_all_documents_of_a_node():
    r = np.random.default_rng(5)
    n, width = 700, 90
    scale = r.random(width) + 0.01
    doc = np.repeat(np.arange(n), 12)
    term = np.concatenate([np.sort(r.choice(width, 12, replace=False)) for _ in range(n)])
    impact = r.integers(1, 999_999, len(doc))
    tree = ball_tree.build_tree(np.arange(n), doc, term, impact, scale, leaf_docs=16, centre_terms=20)
    assert sorted(tree.ids.tolist()) == list(range(n))
    words = [b"%d" % i for i in range(width)]
    batch = ball_tree.Batch([0, 1], [np.array([3, 7, 50]), np.arange(width)], [np.array([1, 2, 1]), np.ones(width, np.int64)], ball_tree.Vocabulary(words))
    weight = r.integers(1, 9000, width)
    search = ball_tree.Searcher(batch, weight, scale, 10)
    bound = search.bounds(tree)
    dense = np.zeros((n, width), dtype=np.int64)
    dense[np.repeat(np.arange(n), np.diff(tree.ptr)), tree.term] = tree.impact
    for i, (t, c) in enumerate(zip(batch.terms, batch.counts)):
        q = np.zeros(width, dtype=np.int64)
        q[t] = weight[t] * c
        score = dense @ q
        for node in range(len(tree.radius)):
            assert bound[i, node] >= score[tree.low[node]:tree.high[node]].max()
    leaf = tree.child < 0
    assert (tree.high - tree.low)[leaf].max() <= 16 and (tree.high - tree.low)[leaf].sum() == n


def test_clustered_documents_are_pruned():
    """Near copies make tight balls: most leaves are never scored."""
    r = np.random.default_rng(1)
    width, docs, terms_of = 400, [], []
    for c in range(40):
        base = np.sort(r.choice(width, 15, replace=False))
        for _ in range(50):
            terms_of.append(base)
    doc = np.repeat(np.arange(2000), 15)
    term = np.concatenate(terms_of)
    impact = np.full(len(doc), 500_000)
    tree = ball_tree.build_tree(np.arange(2000), doc, term, impact, np.ones(width), leaf_docs=25)
    batch = ball_tree.Batch([0], [terms_of[0]], [np.ones(15, np.int64)], ball_tree.Vocabulary([b"%d" % i for i in range(width)]))
    search = ball_tree.Searcher(batch, np.full(width, 1000), np.ones(width), 10)
    search.search(tree)
    assert sorted(-d for _, d in search.best[0]) == list(range(10)) and search.visited < search.leaves / 4


def test_vocabulary_tells_equal_hashes_apart(monkeypatch):
    monkeypatch.setattr(ball_tree, "span_hash", lambda v, s, e: np.full(len(s), 3, np.uint64))
    words = ball_tree.Vocabulary([b"ab", b"abc", b"x", b"yz"])
    text = np.frombuffer(b"yz ab q abc x", np.uint8)
    assert words.find(text, np.array([0, 3, 6, 8, 12]), np.array([2, 5, 7, 11, 13])).tolist() == [3, 0, -1, 1, 2]


def test_query_and_sql(spark, tmp_path):
    docs, items = made(7, 150)
    docs += [(None, docs[5][1]), (900, None)]
    spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id long, text string, lang string, item_id int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((tuple(r) for r in op13_ranked_search(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(docs, items)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert sorted(con.sql(OP13_SQL).fetchall(), key=repr) == got
