"""Removal of repeated byte strings against a plain search over all windows."""
import hashlib
import random

import duckdb
import pytest

from valuemarts.llm import suffix_dedup
from valuemarts.llm.queries import OP12_SQL, op12_suffix_dedup, table


def brute(rows, length):
    """(id, text) rows -> sorted (id, n_bytes, spans, kept)."""
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for p in range(len(b) - length + 1):
                w = b[p:p + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - length + 1):
                if first[b[p:p + length]] < i:
                    gone[p:p + length] = b"\1" * length
        spans, p = [], 0
        while p < len(b):
            q = p
            while q < len(b) and gone[q] == gone[p]:
                q += 1
            if gone[p]:
                spans.append((p, q))
            p = q
        out.append((i, len(b), tuple(spans), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def run(spark, rows, length, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = suffix_dedup.remove_repeats(docs, length).collect()
    return sorted(((r.id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got), key=repr)


def made(seed, n=60):
    r = random.Random(seed)
    word = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 7))) for _ in range(60)]
    base = [" ".join(r.choice(word) for _ in range(r.randint(0, 60))) for _ in range(n)]
    rows = []
    for i, t in enumerate(base):
        if r.random() < 0.5:
            o = r.choice(base)
            a = r.randint(0, max(0, len(o) - 1))
            t = t[:r.randint(0, len(t))] + o[a:a + r.randint(0, 150)] + t
        rows.append((i, t))
    return rows + [(n + i, r.choice(base)) for i in range(8)]


@pytest.mark.parametrize("seed,length", [(1, 50), (2, 16), (3, 33), (4, 50)])
def test_equals_plain_search(spark, seed, length):
    rows = made(seed)
    assert run(spark, rows, length) == brute(rows, length)


def test_edges(spark):
    line = "this line of some length stands in many of the documents here; "
    rows = [(5, None), (None, line), (7, ""), (3, "x" * 49), (4, "x" * 50), (9, "x" * 300), (9, line * 3), (9, line * 3), (11, line),
            (2, "short"), (None, line), (12, "ab" * 200), (13, "ab" * 31), (14, "q" + "ab" * 24 + "q"), (20, "x" * 50), (-4, "pre " + line[:52])]
    rows += [(100 + i, f"{i} own text {i * 7919} {line} and {i ** 3} so on") for i in range(150)]
    assert run(spark, rows, 50, 5) == brute(rows, 50)
    assert run(spark, [], 50) == []
    with pytest.raises(ValueError):
        run(spark, rows, 8)


def test_names_shared_in_a_task_or_between_tasks(spark, monkeypatch):
    """Small flushes and pieces give the same result."""
    rows = made(9, 40) + [(900, " ".join(f"w{i}" for i in range(3000))), (901, "z " + " ".join(f"w{i}" for i in range(500, 2500)))]
    want = brute(rows, 50)
    assert run(spark, rows, 50, 1) == want
    monkeypatch.setattr(suffix_dedup, "FLUSH_ANCHORS", 50)
    assert run(spark, rows, 50, 2) == want
    monkeypatch.setattr(suffix_dedup, "PIECE", 512)
    raw = (rows[-1][1] + rows[-2][1]).encode()
    import numpy as np
    data, off = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    seen = [len(p) for p, _, _, _ in suffix_dedup.pieces(data, off, 50)]
    assert len(seen) > 10 and sum(x - 49 for x in seen) >= len(raw) - 49
    assert run(spark, rows, 50, 1) == want


@pytest.mark.parametrize("most", [0, 1, 3])
def test_hot_names_are_ranked_window_by_window(spark, monkeypatch, most):
    line = "a line that stands in every one of these documents, whatever comes before it or after it"
    r = random.Random(3)
    rows = [(i, f"{r.random()} {r.choice(['', 'same words before '])}{line}{r.choice([' and after', ' or', ''])} {r.random()}") for i in range(90)] + made(8, 30)[5:]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    monkeypatch.setattr(suffix_dedup, "LOCAL_CONTEXTS", most)
    assert run(spark, rows, 50, 6) == brute(rows, 50)


def test_extra_columns_and_other_names(spark):
    t = "0123456789 " * 8
    docs = spark.createDataFrame([(1, t, 5, "a"), (2, t, 6, "b")], "num long, body string, id int, h string")
    got = {r.id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs, text="body", key="num").collect()}
    assert got == {1: t.encode(), 2: b""}


def test_query(spark, tmp_path):
    rows = made(21) + [(None, "n" * 60), (300, None)]
    spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in op12_suffix_dedup(spark, str(tmp_path)).collect()), key=repr)
    want = sorted(((i, n, sum(q - p for p, q in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in brute(rows, 50)), key=repr)
    assert got == want


def test_whole_table_against_duckdb(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.sql(OP12_SQL).fetchall())
    assert sorted(tuple(r) for r in op12_suffix_dedup(spark, sf).collect()) == want and sum(r[2] > 0 for r in want) > 20


def test_whole_table_against_plain_search(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op12_suffix_dedup(spark, "/root/testdata/sf0.001").collect()), key=repr)
    want = sorted(((i, n, sum(q - p for p, q in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in brute(rows, 50)), key=repr)
    assert got == want and any(x[2] for x in want)
