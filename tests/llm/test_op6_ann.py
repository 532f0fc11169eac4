"""Multi-index search against brute force: scores, order, ties, recall."""
import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from valuemarts.llm import ann
from valuemarts.llm.queries import op6_ann

SF = "/root/testdata/sf0.1"


def test_recall_and_exact_scores(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    ids, x = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), dtype=np.float64)
    got = {}
    for r in op6_ann(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = [i for i in ids if i % 20 == 0]
    assert sorted(got) == sorted(want)
    row, found = dict(zip(ids.tolist(), range(len(ids)))), 0
    for q in want:
        s = x @ x[row[q]]
        s[row[q]] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        g = sorted(got[q])
        assert [r for r, _, _ in g] == list(range(1, 21))
        assert all(abs(v - s[row[i]]) < 1e-12 for _, i, v in g)
        assert all((-a[2], a[1]) <= (-b[2], b[1]) for a, b in zip(g, g[1:]))
        found += len({i for _, i, _ in g} & set(ids[best].tolist()))
    assert found >= 0.9 * 20 * len(want)


def test_walk_follows_summed_distance():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6))
    ix = ann.MultiIndex(ann.kmeans(x[:, :3], 7), ann.kmeans(x[:, 3:], 5))
    ix.counts = np.bincount(ix.cells(x), minlength=35)
    cost = -((ix.first @ x[0, :3])[:, None] + (ix.second @ x[0, 3:])[None, :]).ravel()
    want = [c for c in np.argsort(cost) if ix.counts[c]]
    assert ix.walk(x[0], 10 ** 9) == want
    few = ix.walk(x[0], 50)
    assert few == want[:len(few)] and ix.counts[few].sum() >= 50 and ix.counts[few[:-1]].sum() < 50


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (20, [0.0, 2.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [0.5, 0.5], 1), (3, None, 1), (4, [0.0, 0.0], 1),
            (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (8, [1.0], 1), (None, [1.0, 1.0], 1), (40, [1.0, 0.0], 1), (20, [0.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = sorted(map(tuple, ann.search(df, F.col("id") % 20 == 0, k=20).collect()))
    by = {}
    for q, r, i, s in got:
        by.setdefault(q, []).append((r, i, s))
    assert by[0] == [(1, 1, 1.0), (2, 2, 1.0), (3, 40, 1.0), (4, 2, 0.5), (5, 20, 0.0), (6, 20, 0.0)]
    assert [i for _, i, _ in by[40]] == [0, 1, 2, 2, 20, 20]
    assert ann.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_hot_cell_is_split(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([np.tile(rng.normal(size=8), (300, 1)), rng.normal(size=(100, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(df, F.col("id") % 50 == 0, k=5, part_rows=64, recall=1.0).collect()}
    for q in range(0, 400, 50):
        e = (x * x[q]).sum(axis=1)
        e[q] = -np.inf
        best = np.lexsort((np.arange(400), -e))[:5]
        assert [got[q, r] for r in range(1, 6)] == [(int(i), e[i]) for i in best]


def test_queries_of_a_part_are_dealt_to_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    run = lambda most: ann.search(df, F.col("id") % 2 == 0, k=5, part_rows=128, block_rows=most)
    sizes, cogroup = [], type(df.groupBy("vec_id")).cogroup

    def watch(left, right):
        sizes.append(left.count().toPandas())
        return cogroup(left, right)

    monkeypatch.setattr(type(df.groupBy("vec_id")), "cogroup", watch)
    few, whole = sorted(map(tuple, run(32).collect())), sorted(map(tuple, run(10 ** 9).collect()))
    assert few == whole and len(few) == 300 * 5
    assert sizes[0]["count"].max() <= 2 * 32 and sizes[1]["count"].max() > 200 and sizes[0]["part"].nunique() == 5


def test_block_counts():
    got = ann.block_counts(np.array([0, 1, 100, 2000]), 2000, 500_000, 8192)
    assert got.tolist() == [1, 1, 5, 62] and (ann.block_counts(np.array([5]), 5, 8192, 8192) == 1).all()
    assert len(ann.block_counts(np.zeros(0), 0, 0, 10)) == 0
