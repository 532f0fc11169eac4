"""Huffman codes and token files: optimality, exact round trips, offsets."""
import heapq
import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from valuemarts.llm import huffman, token_file
from valuemarts.llm.queries import op9_token_file

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def plain_huffman_cost(counts):
    h = sorted(c for c in counts if c)
    heapq.heapify(h)
    cost = h[0] if len(h) == 1 else 0
    while len(h) > 1:
        a = heapq.heappop(h) + heapq.heappop(h)
        cost += a
        heapq.heappush(h, a)
    return cost


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 10 ** 6), min_size=1, max_size=60).filter(any), st.integers(6, 20))
def test_lengths(counts, limit):
    c = np.array(counts)
    n = huffman.code_lengths(c, limit)
    assert ((n > 0) == (c > 0)).all() and n.max() <= limit
    assert sum(2.0 ** -int(x) for x in n[n > 0]) <= 1
    cost, best = int((n.astype(int) * c).sum()), plain_huffman_cost(counts)
    assert cost >= best and (n.max() >= limit or cost == best)


def test_limit_is_optimal_and_codes_are_prefix_free():
    counts = [1, 1, 2, 4, 8, 16, 32, 64]
    n = huffman.code_lengths(np.array(counts), 4)
    best = min(sum(a * b for a, b in zip(x, counts)) for x in itertools.combinations_with_replacement(range(4, 0, -1), 8) if sum(2.0 ** -k for k in x) <= 1)
    assert (n.astype(int) * counts).sum() == best and n.max() == 4
    codes = [format(int(c), f"0{k}b") for c, k in zip(huffman.canonical(n), n)]
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=400), min_size=1, max_size=8), st.integers(1, 9))
def test_pack_and_decode(seqs, step):
    flat = np.array([x for s in seqs for x in s], dtype=np.int64)
    if not len(flat):
        return
    off = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    n = huffman.code_lengths(np.bincount(flat, minlength=301), 12)
    data, checks = huffman.pack(flat, off, huffman.canonical(n), n, step)
    base = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    bit = np.concatenate([c + 8 * b for c, b in zip(checks, base)])
    count = np.array([min(step, len(s) - a) for s in seqs for a in range(0, len(s), step)], dtype=np.int64)
    got = huffman.Decoder(n).segments(np.frombuffer(b"".join(data), dtype=np.uint8), bit.astype(np.int64), count)
    assert got.tolist() == flat.tolist()


def expect(rows):
    out, start = [], 0
    for i, t in rows:
        ids = np.array([*LIB.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    rows = sorted(zip(t["doc_id"], t["text"]))
    assert sorted(map(tuple, op9_token_file(spark, "/root/testdata/sf0.001").collect())) == expect(rows)


def test_files_and_edges(spark, tmp_path):
    rows = [(5, "e e"), (None, "null id"), (3, ""), (9, None), (3, "longer than the other"), (-4, "x <|endoftext|> y"), (7, "it's " * 3000), (8, "é\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n", "2 as ids", "3 as file")
    token_file.write(df, f"{tmp_path}/f", PATH, block_ids=8, file_ids=2000)
    want = expect([(None, "null id"), (-4, rows[5][1]), (3, ""), (3, rows[4][1]), (5, "e e"), (7, rows[6][1]), (8, "é\n\n"), (9, None)])
    got = token_file.read_digests(spark, f"{tmp_path}/f").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    ids = {r.start: r.ids for r in token_file.read(spark, f"{tmp_path}/f").collect()}
    assert ids[0] == [*LIB.encode("null id", add_special_tokens=False).ids, 2]
    blocks = spark.read.parquet(f"{tmp_path}/f/blocks")
    assert blocks.select("file").distinct().count() > 1
    order = [d for r in sorted(blocks.collect(), key=lambda r: (r.file, r.block)) for d in r.doc_ids]
    assert order == [w[0] for w in want]
    token_file.write(df.limit(0), f"{tmp_path}/e", PATH)
    assert token_file.read(spark, f"{tmp_path}/e").count() == 0


def test_files_are_even_where_ids_are_not(spark, tmp_path):
    """Nine rows of ten have no id, some documents are long, rows repeat."""
    rows = [(None if i % 10 else i, f"text number {i % 40} " * (1 if i % 7 else 12)) for i in range(800)]
    rows += [(None, "the same row")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    token_file.write(df, f"{tmp_path}/f", PATH, block_ids=64, file_ids=1000)
    n = {r.file: r.n for r in spark.read.parquet(f"{tmp_path}/f/blocks").groupBy("file").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    total = sum(n.values())
    assert len(n) >= 6 and max(n.values()) <= 1.6 * total / len(n)
    got = sorted(map(tuple, token_file.read_digests(spark, f"{tmp_path}/f").collect()), key=lambda r: r[1])
    want = expect(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert [r[0] for r in got] == [r[0] for r in want] and got[-1][1] + got[-1][2] == total
    assert sorted((-1 if r[0] is None else r[0], r[2], r[3]) for r in got) == sorted((-1 if r[0] is None else r[0], r[2], r[3]) for r in want)
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))


def test_words_in_a_row_are_the_words_alone():
    e = token_file.LibraryEncoder(open(PATH, "rb").read())
    words = [" the", " éclair", "x", " ", " 12", " don", "'t", " ßtraße", " 日本語", " a", " ª", "\n\n", " über", " x1"] * 40
    n, ids = e._words(words)
    m, alone = e._alone(words)
    assert n.tolist() == m.tolist() and ids.tolist() == alone.tolist()
    e.width = e.width * 0 + 1                      # widths that do not fit: encoded alone
    n, ids = e._words(words)
    assert n.tolist() == m.tolist() and ids.tolist() == alone.tolist()
