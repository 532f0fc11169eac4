"""Secret scans: base spans against the patterns as given, the CRF against
enumeration, and what it adds."""
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from valuemarts.llm import secret_scan as ss
from valuemarts.llm.queries import op10_secret_scan

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


PIECES = st.sampled_from(["password", "passwd", "Secret", "ToKen", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "AKIAB",
                          "0123456789abcdef", "deadbeef", "a.b-c", "\n", "é", "ſ", "K", "x", "=="])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_spans(text):
    assert ss.base_spans(text) == plain(text)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    t = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    text = dict(zip(t["doc_id"], t["text"]))
    rows = op10_secret_scan(spark, sf).collect()
    assert len(rows) == len(text)
    added = 0
    for r in rows:
        base = plain(text[r.doc_id] or "")
        names = [f"{ss.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("crf")] == names
        added += len(spans) - len(names)
    assert added <= 0.2 * sum(r.n_assign + r.n_access + r.n_hex for r in rows)


def small_crf(rng):
    c = ss.Crf(rng.normal(size=(1 << ss.BITS, 3)), rng.normal(size=(3, 3)))
    return c, ss.sequences(["key abc12345/q.x1y2z3w4 and zz\nnone here", "a1b2c3d4e5 x 99aa88bb77 u.v"])


def paths(c, s, a, b):
    e, m = c.scores(s)
    for y in itertools.product(range(3), repeat=b - a):
        yield y, sum(e[a + i, k] for i, k in enumerate(y)) + sum(m[p, q] for p, q in zip(y, y[1:]))


def test_viterbi_marginals_and_normaliser_by_enumeration():
    c, s = small_crf(np.random.default_rng(4))
    states, (p, _, total), z = c.viterbi(s), c.marginals(s), 0.0
    assert len(s.off) == 3
    for a, b in zip(s.off[:-1], s.off[1:]):
        every = list(paths(c, s, a, b))
        assert max(every, key=lambda x: x[1])[0] == tuple(states[a:b])
        w = np.exp([v for _, v in every])
        z += np.log(w.sum())
        for i in range(b - a):
            for k in range(3):
                assert abs(sum(x for (y, _), x in zip(every, w) if y[i] == k) / w.sum() - p[a + i, k]) < 1e-9
    assert abs(z - total) < 1e-9


def test_learns_what_the_patterns_miss():
    rng = random.Random(0)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    texts = [f"the word {rng.choice(['password=', 'token = '])}{hexa(18)} and so" for _ in range(150)]
    texts += [f"call me at room{rng.randrange(10 ** 6):06d}x on user{rng.randrange(10 ** 5):05d}@mail9.example.com now" for _ in range(150)]
    crf = ss.train(texts, [[(a, b) for a, _, b in ss.base_spans(t)] for t in texts])
    secret = hexa(18)
    t = f"his credentials = {secret} and room123456x of user12345@mail9.example.com"
    assert plain(t) == []
    got = crf.spans([t, "", "plain words only"])
    assert got == [[(t.index(secret), t.index(secret) + 18)], [], []]


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "token=abcdef"), (1, "AKIA" + "A" * 16), (1, "AKIA" + "A" * 16), (3, "x " * 60000 + "token='abc.def'")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as spans", "1 as n_hex")
    got = sorted((str(r.doc_id), r.n_assign, r.n_access, r.spans) for r in ss.scan(df, ss.fit(df)).collect())
    assert got == [("1", 0, 0, ""), ("1", 0, 1, "access:0:20"), ("1", 0, 1, "access:0:20"), ("2", 0, 0, ""), ("3", 1, 0, "assign:120000:120014"), ("None", 1, 0, "assign:0:12")]
    assert ss.scan(df.limit(0), ss.fit(df.limit(0))).count() == 0
