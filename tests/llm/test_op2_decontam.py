"""Decontamination against a plain edit-distance search."""
import random

import numpy as np
import pyarrow.parquet as pq

from valuemarts.llm import decontam
from valuemarts.llm.queries import op2_decontaminate

SF = "/root/testdata/sf0.01"


def best_part(item, text):
    """Least edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def folded(t):
    cp, _, _ = decontam.fold([t])
    return "".join(map(chr, cp)).strip()


def test_edits_up_to_the_budget():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [" ".join(word() for _ in range(n)) for n in (14, 30, 50, 70)]
    texts = []
    for k in range(60):
        item = list(rng.choice(items))
        for _ in range(rng.randint(0, len(item) // 14)):
            j, what = rng.randrange(len(item)), rng.random()
            if what < 0.34:
                item[j] = rng.choice("klmnop")
            elif what < 0.67:
                del item[j]
            else:
                item.insert(j, rng.choice("klmnop"))
        pre = " ".join(word() for _ in range(rng.choice([0, 0, 30])))
        texts.append(f"{pre}{' ' if pre else ''}{''.join(item)} {' '.join(word() for _ in range(rng.choice([0, 20])))}")
    idx = decontam.index_items(list(range(4)), items, 12, 0.05, 12, 0)
    got = {(d, i): (s, e, c) for d, i, s, e, c, _ in decontam.find(idx, texts)}
    seen = 0
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            least = best_part(folded(item), folded(t))
            want = least <= int(idx.budget[i])
            assert ((d, i) in got) == want, (d, i, least)
            if want:
                s, e, c = got[d, i]
                assert c == least
                assert best_part(folded(t[s:e]), folded(item)) <= c and abs(len(folded(t[s:e])) - len(folded(item))) <= c
                seen += 1
    assert 20 < seen < 60


def test_query_finds_what_contains_finds(spark):
    rows = op2_decontaminate(spark, SF).collect()
    docs = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    bench = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    exact = {(d, i) for d, t in zip(docs["doc_id"], docs["text"]) for i, b in zip(bench["item_id"], bench["text"]) if b in t}
    got = {(r.doc_id, r.item_id) for r in rows}
    assert exact and exact <= got and len(got - exact) <= 3
    text = dict(zip(docs["doc_id"], docs["text"]))
    item = dict(zip(bench["item_id"], bench["text"]))
    for r in rows:
        if r.edits == 0:
            assert folded(text[r.doc_id][r.start:r.end]) == folded(item[r.item_id])


def test_edges(spark):
    item = "The quick brown fox jumps over the lazy dog and then runs away from the angry bear"
    docs = [(1, f"x {item.upper().replace(' ', ', ')}!", 1), (2, None, 1), (None, item, 1), (3, "", 1), (4, item + " " + item, 1),
            (5, "nothing here", 1), (3, item, 1), (3, item, 1), (6, "a b " * 40000 + item, 1)]
    bench = [(7, item, 1), (8, None, 1), (9, "", 1), (10, "short", 1), (None, item, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, start int")
    b = spark.createDataFrame(bench, "item_id long, text string, edits int")
    got = decontam.matches(d, b).collect()
    ids = sorted([str(r.id) for r in got if r.item_id == 7])
    assert ids == sorted(["1", "None", "3", "3", "4", "4", "6"])
    assert sum(r.item_id is None for r in got) == 7 and not {8, 9, 10} & {r.item_id for r in got}
    assert decontam.matches(d.limit(0), b).count() == 0
    assert decontam.matches(d, b.limit(0)).count() == 0
    blocks = decontam.matches(d, b, block_chars=1).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, got))


def test_parts_of_long_items():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(120)]
    idx = decontam.index_items([1], [" ".join(words)], 12, 0.05, 12, 30)
    assert len(idx.texts) == 7
    got = decontam.find(idx, ["zz " + " ".join(words[28:64]) + " yy", " ".join(reversed(words))])
    assert {g[0] for g in got} == {0} and isinstance(got[0][2], int) and np.all(idx.bound >= 12)


def test_passages_and_short_items(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 9)))
    item, other = [word() for _ in range(59)], [[word() for _ in range(300)] for _ in range(8)]
    say = lambda k, x: " ".join(other[k][:100] + x + other[k][100:])
    docs = [(0, say(0, item)), (1, say(1, item[:40])), (2, say(2, item[25:45])), (3, say(3, item[30:36])), (4, say(4, [])),
            (5, "What is two-plus TWO?"), (6, "that is two plus two."), (7, "what is two plus twofold"), (8, "Is what is two plus two what? What is\ttwo plus two")]
    bench = [(1, " ".join(item)), (2, "what is two plus two"), (3, "?!")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = decontam.matches(d, b, part_words=decontam.PASSAGE_WORDS).collect()
    assert sorted((r.id, r.item_id) for r in got) == [(0, 1), (1, 1), (2, 1), (5, 2), (8, 2), (8, 2)]
    text = dict(docs)
    for r in got:
        part = folded(text[r.id][r.start:r.end])
        if r.item_id == 2:
            assert part == "what is two plus two" and r.edits == 0
        elif r.id == 0:
            assert part == " ".join(item) and r.edits == 0
        else:                                   # a part may reach beyond the passage by its edits
            assert len(part.split()) >= (30 if r.id == 1 else 13) and r.edits <= 0.08 * len(part)
            assert best_part(part, " ".join(item)) <= 2 * r.edits
    short = sorted((r.id, r.item_id) for r in decontam.matches(d, b).collect())         # without parts
    assert short == [(0, 1), (5, 2), (8, 2), (8, 2)]


def test_bands_follow_each_item():
    items = [" ".join(f"word{a}{b}" for a in "abcdefgh" for b in "klmnopqrst"), "one two three four five six seven eight"]
    idx = decontam.index_items([1, 2], items, 12, 0.08, 12, 0)
    assert (idx.width == idx.budget + 1).all() and idx.width[0] > 10 * idx.width[1]


def test_very_short_items_match_whole_texts_only(spark):
    d = spark.createDataFrame([(0, "Yes"), (1, " yes!"), (2, "yes it is"), (3, "it is, yes"), (4, "no"), (5, "Yes and yes"), (6, "")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "yes"), (2, "It is, yes.")], "item_id long, text string")
    assert sorted((r.id, r.item_id) for r in decontam.matches(d, b).collect()) == [(0, 1), (1, 1), (3, 2)]
    assert sorted((r.id, r.item_id) for r in decontam.matches(d, b, whole_below=0).collect()) == [(0, 1), (1, 1), (2, 1), (3, 1), (3, 2), (5, 1), (5, 1)]
