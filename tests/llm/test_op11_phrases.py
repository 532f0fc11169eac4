"""Collocations against plain counting, and the trie against a Counter."""
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from valuemarts.llm import phrases
from valuemarts.llm.queries import OP11_SQL, op11_phrases


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, least, longest=5, top=2000):
    out = []
    for lang in sorted({x or "und" if x is None else x for x, _ in rows}):
        f = Counter()
        for x, text in rows:
            if ("und" if x is None else x) == lang:
                for w in pieces(text):
                    for k in range(1, longest + 1):
                        for i in range(len(w) - k + 1):
                            f[tuple(w[i:i + k])] += 1
        n = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: c for p, c in f.items() if len(p) >= 2 and c >= least}
        gone = set()
        for p, c in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if c >= cand[p[i:i + k]]:
                        gone.add(p[i:i + k])
        rank = []
        for p, a in cand.items():
            if p in gone:
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rank.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], n, score))
        out += [(lang, i, p.decode(), a, l, r, n, s) for i, (_, _, p, a, l, r, n, s) in enumerate(sorted(rank)[:top], 1)]
    return sorted(out)


def made(seed, n=300):
    r = random.Random(seed)
    word = [f"{r.choice('abcéß')}{i}" for i in range(40)]
    fixed = ["New York city hall", "to be or not to be", "a a a a a a a", "x y x y x y", "É é E e"]
    rows = []
    for _ in range(n):
        t = []
        for _ in range(r.randint(0, 25)):
            t.append(r.choice(fixed) if r.random() < 0.2 else r.choices(word, [1 / (i + 1) for i in range(40)])[0])
            t.append(r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "! ", "; x:y?", "\r\n"]))
        rows.append((r.choice(["en", "en", "fr", None, "und", ""]), "".join(t)))
    return rows


def run(spark, rows, least, parts=3, **more):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(parts)
    return sorted(tuple(r) for r in phrases.collocations(docs, least, **more).collect())


@pytest.mark.parametrize("seed,least", [(1, 10), (2, 3), (3, 25)])
def test_equals_plain_counting(spark, seed, least):
    rows = made(seed)
    want = brute(rows, least)
    assert len(want) > 20 and run(spark, rows, least) == want


def test_bitmap_that_says_yes_to_all(spark, monkeypatch):
    """A saturated bitmap costs work only; other lengths and limits."""
    rows = made(4) + [("en", " ".join(t for _, t in made(5, 100)))]
    want = brute(rows, 8, top=15)
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    assert run(spark, rows, 8, 1, top=15) == want
    assert run(spark, rows, 8, 7, longest=3) == brute(rows, 8, 3)
    assert run(spark, rows, 8, longest=2) == brute(rows, 8, 2)


def test_clashing_ids_are_counted_again(spark, monkeypatch):
    """A clash of ids is found by the words and another salt is taken."""
    ids = np.array([5, 5], np.uint64)
    blob = [phrases._zip(ids[:1], np.array([3]), np.array([2]), np.array([2]), np.frombuffer(b"ab", np.uint8), np.frombuffer(b"en", np.uint8)),
            phrases._zip(ids[:1], np.array([4]), np.array([2]), np.array([2]), np.frombuffer(b"ac", np.uint8), np.frombuffer(b"en", np.uint8))]
    assert phrases._merge_words(blob)[3] == 1 and phrases._merge_words([blob[0], blob[0]])[1].tolist() == [6]
    assert (phrases.lang_seeds(["en", "fr"], 0) != phrases.lang_seeds(["en", "fr"], 1)).all()


def test_edges(spark):
    assert run(spark, [], 2) == []
    assert run(spark, [(None, None), ("en", ""), ("en", " \t\n..")], 1) == []
    rows = [(None, "A b")] * 3 + [("und", "a B")] * 2 + [("en", "a b. c"), ("en", "one"), ("xx", "hot pair " * 4000), ("en", "w" * 9000 + " z")]
    assert run(spark, rows, 2) == brute(rows, 2)
    assert run(spark, rows, 1) == brute(rows, 1)


def test_trie_counts_and_spills():
    r = np.random.default_rng(3)
    want, got, trie = Counter(), Counter(), phrases.HatTrie(3, burst=100)

    def check(run):
        keys, counts = run
        rows = [tuple(k) for k in keys.tolist()]
        assert rows == sorted(set(rows))
        got.update(dict(zip(rows, counts.tolist())))

    for _ in range(30):
        keys = np.minimum(r.geometric(0.2, (400, 3)), 30).astype(np.uint64)
        counts = r.integers(1, 4, 400)
        trie.add(keys, counts)
        for k, c in zip(keys.tolist(), counts.tolist()):
            want[tuple(k)] += c
        if trie.size > 900:
            for run in trie.spill(300):
                check(run)
            assert trie.size <= 300
    assert trie.children
    for run in trie.spill(0):
        check(run)
    assert got == want and trie.size == 0


def test_parts_cut_long_texts_at_piece_ends():
    text = ("some words here, " * 50 + "x" * 200 + "; ") * 4
    raw = np.frombuffer(text.encode(), np.uint8)
    got = [p.tobytes().decode() for p, _, _, _ in phrases.parts(raw, np.array([0, len(raw)]), 300)]
    assert "".join(got) == text and len(got) > 8 and all(p[-1] in ",;" or p == got[-1] for p in got)


def test_query_and_sql(spark, tmp_path):
    rows = [(x, t * 6) for x, t in made(11, 400)]
    spark.createDataFrame([(i, t, x, "s") for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, n string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in op11_phrases(spark, str(tmp_path)).collect())
    assert got == brute(rows, 100) and len(got) > 50
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.sql(OP11_SQL).fetchall()) == got
