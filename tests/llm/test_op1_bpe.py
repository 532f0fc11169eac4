"""BPE against the tokenizers library, and exact round trips."""
import hashlib
import random
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from valuemarts.llm import bpe, pretoken
from valuemarts.llm.queries import op1_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    return bpe.BpeModel(bpe.read_tokenizer(PATH), piece=64)


def same(model, texts):
    flat, off = model.encode(texts)
    want = LIB.encode_batch(texts, add_special_tokens=False)
    for i, w in enumerate(want):
        got = flat[off[i]:off[i + 1]]
        assert got.tolist() == w.ids, texts[i][:80]
        assert model.decode(got).decode() == texts[i]


def test_hand_cases(model):
    same(model, ["", " ", "  ", "\n", "\n\n x", "a  b", "it's we'll I'd 'tis ''s 's's x'S", " 's", "\t's", "!'re", "don't",
                 "aaaaaaaa aaaaa", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x <|endoftext", "1'll 22'd", "é'm ñ  \n\t z ",
                 "日本語テキスト 中文", "🙂🙂 👩‍👩‍👧", "\x00\x1f\x85\xa0  x", "a" * 500, "ab " * 300, "end  "])


def test_every_code_point(model):
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x30000, 7))]
    same(model, ["".join(f"a{c}b {c}1{c} " for c in every[i:i + 200]) for i in range(0, len(every), 200)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab 's'\n\tll1é!re<|endoftx>") | st.characters(codec="utf-8"), max_size=200), max_size=4))
def test_any_text(model, texts):
    same(model, texts)


def test_documents(model):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    same(model, texts)


def test_cache_starts_afresh():
    m = bpe.BpeModel(bpe.read_tokenizer(PATH))
    m.cache.limit = 50
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:40]
    for t in texts:
        same(m, [t])


def test_query_and_edges(spark, tmp_path):
    rows = [(1, "Hello there", "x"), (2, None, "y"), (2, "", None), (None, "it's <|endoftext|>", "z"), (1, "Hello there", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op1_bpe(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = LIB.encode(t or "", add_special_tokens=False).ids
        back = LIB.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    df = bpe.encode_texts(spark.read.parquet(f"{tmp_path}/documents.parquet"), PATH)
    back = bpe.decode_ids(df, PATH).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, _ in rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_texts(empty, PATH).count() == 0


@pytest.mark.parametrize("word", ["random", "run", "pairs", "accents"])
def test_long_words(model, word):
    r = random.Random(5)
    n = 1_000_000
    text = {"random": "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n)), "run": "a" * n, "pairs": "ab" * (n // 2),
            "accents": "".join(r.choices("éàßñ日本", k=n // 4))}[word]
    start = time.perf_counter()
    ids, off = model.encode([text, "short", text[:700]])
    assert time.perf_counter() - start < 30
    want = [LIB.encode(t, add_special_tokens=False).ids for t in (text, "short", text[:700])]
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == want


def test_a_batch_is_encoded_in_slices(model):
    texts = [None if i % 50 == 7 else f"word{i % 9} " * (i % 300) for i in range(4000)] + ["long text " * 200_000, ""]
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts) + 3)), pa.array(["x", "y", "z", *texts])], ["k", "__text"])
    batch = whole.slice(3)                                             # an Arrow slice begins within its buffers
    parts = list(bpe.encode_batch(model, batch, True))
    assert all(p.num_rows == 1 or sum(len(texts[i - 3] or "") for i in p.column(0).to_pylist()) <= 1 << 20 for p in parts)
    got = pa.Table.from_batches(parts)
    assert got["k"].to_pylist() == list(range(3, len(texts) + 3))
    flat, off = model.encode([t or "" for t in texts])
    assert got["ids"].to_pylist() == [flat[x:y].tolist() for x, y in zip(off[:-1], off[1:])]
    assert got["n_tokens"].to_pylist() == np.diff(off).tolist()


def test_the_class_table_needs_little_memory(monkeypatch):
    monkeypatch.setattr(pretoken, "_CLASS", [])
    tracemalloc.start()
    try:
        table = pretoken.classes()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 << 20                                             # an object per code point takes 100 MB
    assert [int(table[ord(c)]) for c in "aÿ7 _ 日Ⅷ"] == [1, 1, 2, 4, 3, 4, 1, 2]
