"""Toxicity: held-out quality, the pair term, defined results at the edges."""
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from valuemarts.llm import toxicity
from valuemarts.llm.queries import op5_toxicity

SF = "/root/testdata/sf0.1"


def test_held_out(spark):
    rows = op5_toxicity(spark, SF).collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    hit = sum(p and t for p, t in held)
    assert hit >= 0.8 * sum(t for _, t in held) and hit >= 0.97 * sum(p for p, _ in held)


def test_pairs_are_learned():
    rng = np.random.default_rng(0)
    texts, y = [], []
    for _ in range(1500):                       # toxic only when both words meet
        a, b = rng.random() < 0.4, rng.random() < 0.4
        texts.append(" ".join(["rat"] * a + ["folk"] * b + [f"w{rng.integers(50)}" for _ in range(6)]))
        y.append(float(a and b))
    idx, off = toxicity.term_sets(pa.array(texts))
    m = toxicity.train(idx, off, np.array(y), np.ones(len(y)), rounds=200)
    s = m.score(*toxicity.term_sets(pa.array(["rat folk w1", "rat w1 w2", "folk w1 w2", "w1 w2"])))
    assert s[0] > 0.7 and s[1:].max() < 0.5


def test_pair_with_a_word_that_tells_nothing_alone():
    rng = np.random.default_rng(0)
    texts, y = [], []
    for _ in range(3000):                       # rat is toxic with folk, vile without it; folk is as common in clean texts
        word, folk = rng.choice(["rat", "vile", ""], p=[0.3, 0.3, 0.4]), rng.random() < 0.5
        texts.append(" ".join([word] + ["folk"] * folk + [f"w{chr(97 + rng.integers(25))}x" for _ in range(6)]))
        y.append(float(folk if word == "rat" else word == "vile" and not folk))
    idx, off = toxicity.term_sets(pa.array(texts))
    y = np.array(y)
    has = np.array(["folk" in t for t in texts])
    assert abs(y[has].mean() - y[~has].mean()) < 4 * np.sqrt(y.var() * 4 / len(y))       # no effect of its own
    m = toxicity.train(idx, off, y, np.ones(len(y)), rounds=200)
    s = m.score(*toxicity.term_sets(pa.array([f"{t} wax wbx wcx wdx wex wfx" for t in ("rat folk", "rat", "folk", "vile folk", "vile", "")])))
    assert min(s[0], s[4]) > 0.7 and max(s[1], s[2], s[3], s[5]) < 0.3


def test_factors_count_without_a_linear_weight():
    idx, off = toxicity.term_sets(pa.array(["rat folk"]))
    table = np.zeros((1 << toxicity.BITS, 1 + toxicity.FACTORS), dtype=np.float32)
    table[idx, 1:] = 1
    assert abs(toxicity.FactorMachine(0.0, table).logits(idx, off)[0] - toxicity.FACTORS) < 1e-6


def test_brute_force_logits():
    rng = np.random.default_rng(1)
    table = rng.normal(0, 0.3, (1 << toxicity.BITS, 1 + toxicity.FACTORS)).astype(np.float32)
    m = toxicity.FactorMachine(-0.5, table)
    idx, off = toxicity.term_sets(pa.array(["Ab cd, EF ab", "", None, "é É zz"]))
    assert off[1] - off[0] == 3 and off[2] == off[1] == off[3] and off[4] - off[3] == 2
    for k, z in enumerate(m.logits(idx, off)):
        f = idx[off[k]:off[k + 1]]
        want = -0.5 + table[f, 0].sum() + sum(table[f[i], 1:] @ table[f[j], 1:] for i in range(len(f)) for j in range(i))
        assert abs(z - want) < 1e-4


def test_edges(spark):
    docs = spark.createDataFrame([(1, "you scum"), (2, None), (None, "scum"), (1, "you scum"), (3, "scum " * 30000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 1), (2, None, 0)], "doc_id long, toxic int, text int")
    m = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.predict(docs, m).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert max(r.score for r in toxicity.predict(docs, none).collect()) < 1e-9
    assert toxicity.predict(docs.limit(0), m).count() == 0 and math.isfinite(m.bias)
