"""Texts that collide under polynomial hashes are told apart everywhere."""
import numpy as np
from tokenizers import Tokenizer

from valuemarts.llm import bpe, lm_score, near_dup, pretoken, token_file
from valuemarts.llm.common import span_hash, split_of
from valuemarts.llm.queries import TOKENIZER


def thue_morse(turns, letters="ab"):
    a = letters[0]
    for _ in range(turns):
        a += a.translate(str.maketrans(letters, letters[::-1]))
    return a, a.translate(str.maketrans(letters, letters[::-1]))


def test_hash_of_thue_morse_words():
    for turns in (5, 7, 10, 11):
        a, b = thue_morse(turns)
        for values in (np.frombuffer((a + b + a).encode(), np.uint8), np.frombuffer((a + b + a).encode("utf-32-le"), np.uint32)):
            n = len(a)
            h = span_hash(values, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
            assert h[0] == h[2] != h[1]


def test_ids_are_those_of_the_library(spark, tmp_path):
    a, b = thue_morse(11)
    texts = [a, b, f"{b} {a}", a]
    want = [e.ids for e in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [list(r.ids) for r in bpe.encode_texts(docs, TOKENIZER).orderBy("doc_id").collect()]
    assert got == want


def test_a_forced_collision_in_the_cache(monkeypatch):
    """All hashes equal: every pre-token still gets its own ids."""
    monkeypatch.setattr(pretoken, "span_hash", lambda v, s, e: np.full(len(s), 7, np.uint64))
    cache = pretoken.TokenCache(lambda words: (np.array([len(w) for w in words]), np.array([ord(c) for w in words for c in w], dtype=np.int32)))
    for texts in (["ab cd", "cd"], ["x", "ab", "", "abc ab"]):
        ids, off = cache.tokens(texts)
        assert ["".join(map(chr, ids[p:q])) for p, q in zip(off[:-1], off[1:])] == texts


def test_no_false_link_and_two_words(spark):
    a, b = thue_morse(10)
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    got = {r.id: r.component_id for r in near_dup.groups(docs, shingle=2).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    docs = spark.createDataFrame([(i, f"{a} {b}" if i % 2 else a) for i in range(20)], "doc_id long, text string")
    train = split_of("id", 10) != 0
    n = {r.id: (r.n_tokens, r.n_known) for r in lm_score.score(docs, train).collect()}
    assert n[1] == (3, 3) and n[2] == (2, 2)


def test_token_file_ids(spark, tmp_path):
    a, b = thue_morse(11)
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    token_file.write(docs, str(tmp_path / "f"), TOKENIZER, end_id=2)
    want = [len(Tokenizer.from_file(TOKENIZER).encode(t, add_special_tokens=False).ids) + 1 for t in (a, b)]
    assert [r.n_tokens for r in token_file.read_digests(spark, str(tmp_path / "f")).orderBy("doc_id").collect()] == want
