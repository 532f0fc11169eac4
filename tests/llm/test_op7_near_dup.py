"""Near-duplicates against brute force over all pairs of sets."""
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from valuemarts.llm import near_dup
from valuemarts.llm.common import Scratch, flat_utf8
from valuemarts.llm.graph import components
from valuemarts.llm.queries import op7_near_dup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, threshold=80):
    """Rows of (id, text) -> sorted (id, n, component, kept)."""
    s = [sets_of(t, k) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = rows[a][0], rows[b][0]
        if x is None or y is None or not s[a] or not s[b]:
            continue
        if 100 * len(s[a] & s[b]) >= threshold * len(s[a] | s[b]):
            x, y = sorted((root(x), root(y)))
            parent[y] = x
    return sorted(((i, len(s[a]), None if i is None else root(i), i is None or root(i) == i) for a, (i, _) in enumerate(rows)), key=str)


def run(spark, rows, k, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n", "'x' as rep", "2 as component")
    return sorted(map(tuple, near_dup.groups(df, shingle=k, **kw).collect()), key=str)


def test_edges(spark):
    rows = [(5, "A b C d"), (3, "a B\tc\nd"), (9, None), (8, ""), (7, " \t\n"), (6, "one"), (4, "ONE"), (None, "a b c d"),
            (None, None), (2, "one two"), (2, "x y z"), (1, "X Y Z"), (10, "one two"), (3, "a B\tc\nd"), (11, "é É ß"), (12, "é É SS")]
    assert run(spark, rows, 2) == brute(rows, 2)
    assert run(spark, [], 2) == []


@pytest.mark.parametrize("shingle", [2, 5])
def test_chains_of_edits(spark, shingle):
    rng = random.Random(shingle)
    words = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for g in range(12):                       # families whose members drift apart, near the threshold
        base = [rng.choice(words) for _ in range(rng.choice([8, 40, 120]))]
        for _ in range(rng.choice([1, 3, 25])):
            for _ in range(rng.choice([0, 1, 2, 3])):
                base[rng.randrange(len(base))] = rng.choice(words)
            rows.append((i, " ".join(base)))
            i += 1
    rng.shuffle(rows)
    assert run(spark, rows, shingle) == brute(rows, shingle)


def test_one_hub_is_not_enough(spark):
    # edits of one base: copies miss each other more often than they miss the base, which has the largest id
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    rows = [(999, " ".join(base))]
    for i in range(60):
        t = list(base)
        for j in rng.sample(range(60), 3):
            t[j] = f"e{i}_{j}"
        rows.append((i, " ".join(t)))
    want = brute(rows, 2)
    assert len({r[2] for r in want}) < 5
    assert run(spark, rows, 2, open_pairs=0, max_rounds=2) == want      # more hubs, then all open pairs


def edits(n, seed):
    """Edits of one base: most pairs are a little less similar than the threshold."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(60)]
    rows = [(n, " ".join(base))]
    for i in range(n):
        t = list(base)
        for j in rng.sample(range(60), 4):
            t[j] = f"e{i % 40}_{j}"
        rows.append((i, " ".join(t)))
    return rows


def test_a_large_group_gives_no_pair_per_pair_of_members(spark, monkeypatch):
    rows, seen, plain = edits(300, 5), [], near_dup.similar
    monkeypatch.setattr(near_dup, "similar", lambda pairs, *a: seen.append(pairs.count()) or plain(pairs, *a))
    assert run(spark, rows, 2) == brute(rows, 2)
    assert sum(seen) < 12 * len(rows)                                    # not 300 * 299 / 2


@pytest.mark.parametrize("block", [(16, 1 << 20), (1024, 500)])
def test_blocks_of_a_bucket_meet(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "SMALL", 3)
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", block[0])
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", block[1])
    rows = edits(90, 8) + [(3, "b1 b2 b3"), (None, "b1 b2 b3"), (500, "b1 b2 b3"), (501, "")]
    assert run(spark, rows, 2) == brute(rows, 2)


def test_query_on_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, op7_near_dup(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute([tuple(r) for r in docs], 2)


def test_sketch_estimates():
    common = [f"c{i}" for i in range(900)]
    a, b = " ".join(common + [f"a{i}" for i in range(50)]), " ".join(common + [f"b{i}" for i in range(50)])
    sets, off = near_dup.shingle_sets(*flat_utf8(pa.array([a, b])), 1)
    keys, odd = near_dup.sketches(sets, off, 16, 3, 240)
    z = sum(bin(int(x) & (2 ** 64 - 1)).count("1") for x in odd[0] ^ odd[1])
    m = near_dup.SKETCH_BITS
    estimate = 1 + m / 2 * np.log(1 - 2 * z / m) / (2 * 240)
    assert abs(estimate - 0.9) < 0.08
    assert (keys[0] == keys[1]).any()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(240)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = sorted((n, root(n)) for n in {n for a, b in edges if a != b for n in (a, b)})
    df = spark.createDataFrame(edges, "x long, y long")
    with Scratch(spark, "test") as tmp:
        for size in (10 ** 6, 70):
            assert sorted(map(tuple, components(df, tmp, size).collect())) == want
        assert components(df.limit(0), tmp).count() == 0


def test_a_hub_s_links_spread_over_the_partitions(spark):
    links = spark.createDataFrame([(5, 10 + i) for i in range(6000)] + [(7, 5)], "x long, y long")
    with Scratch(spark, "test") as tmp:
        got = components(links, tmp, 1000).collect()
    assert len(got) == 6002 and {r.component for r in got} == {5}
    sizes = [r["n"] for r in links.selectExpr("greatest(x, y) as u", "least(x, y) as v").repartition(7, "u", "v")
             .selectExpr("spark_partition_id() as p").groupBy("p").count().withColumnRenamed("count", "n").collect()]
    assert len(sizes) == 7 and max(sizes) < 1.5 * 6001 / 7
