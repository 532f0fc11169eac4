"""Language ID: held-out accuracy, defined results at the edges."""
import zlib

from pyspark.sql import functions as F

from valuemarts.llm import langid
from valuemarts.llm.queries import op4_langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op4_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang is not None]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_edges(spark):
    rows = [(1, "hello there my friend", "en", 1), (2, "bonjour très cher été", "fr", 1), (3, None, "en", 1), (4, "12 !? 34", "en", 1),
            (5, "", None, 1), (None, "hello my", "en", 1), (1, "hello there my friend", "en", 1), (7, "hello there " * 20000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.fit(df, F.lit(True))
    assert model.langs == ["en", "fr"]
    got = sorted(map(tuple, langid.predict(df, model).collect()), key=str)
    by = {r[0]: r for r in got}
    assert len(got) == len(rows) and by[7][1] == "en" and by[2][1] == "fr" and by[None][1] == "en"
    assert all(by[i][1:] == ("und", 0.0) for i in (3, 4, 5))
    none = langid.fit(df, F.lit(False))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_batches_do_not_matter():
    import numpy as np
    texts = ["Größe und", "hello", "", "été là", "x" * 3000] * 70
    one = np.concatenate([langid.bit_sets([t])[0] for t in texts[:5]])
    many, _ = langid.bit_sets(texts)
    assert (many[5:10] == one).all()


def plain_grams(text):
    """Distinct 1- to 3-grams of the lower-cased text, everything but letters one blank each."""
    t = "".join(c if c.isalpha() else " " for c in f" {text.lower()}  ")
    n = len(text) + 1
    return {t[i:i + k] for k in (1, 2, 3) for i in range(n)}


def test_equals_a_plain_kernel_ridge(spark):
    """With every training text a landmark the model is kernel ridge itself."""
    import random

    import numpy as np
    r = random.Random(2)
    words = {"en": "the of and house tree water light good morning friend".split(), "de": "der und das haus baum wasser licht guten morgen freund".split(),
             "fr": "le et la maison arbre eau lumière bonjour matin ami".split()}
    rows = [(3 * i + j, " ".join(r.choices(w, k=r.randint(3, 12))), x) for j, (x, w) in enumerate(words.items()) for i in range(4 + 6 * j)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True))
    assert model.langs == ["de", "en", "fr"]
    sets = [plain_grams(t) for _, t, _ in rows]
    new = ["guten morgen water", "la maison et the house", "baum", "light light light", "eau de la maison"]

    def kernel(a, b):
        return np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])
    k = kernel(sets, sets)
    y = np.array([[1.0 if x == n else -1.0 for n in model.langs] for _, _, x in rows])
    w = 1 / np.sqrt(np.array([sum(z == x for _, _, z in rows) for _, _, x in rows]))
    wkw = k * w[:, None] * w[None, :]
    rank = int((np.linalg.eigvalsh(k) > 1e-6 * np.linalg.eigvalsh(k).max()).sum())
    alpha = np.linalg.solve(wkw + 1e-2 * np.trace(wkw) / rank * np.eye(len(k)), y * w[:, None])
    want = kernel([plain_grams(t) for t in new], sets) @ (alpha * w[:, None])
    bits, _ = langid.bit_sets(new)
    got = (bits.astype(np.float32) @ model.weights) / np.sqrt(bits.sum(axis=1, dtype=np.int64))[:, None]
    assert np.abs(got - want).max() < 0.05 and (got.argmax(axis=1) == want.argmax(axis=1)).all()
    p = np.exp(4 * want) / np.exp(4 * want).sum(axis=1, keepdims=True)
    lang, score = model.predict(new)
    assert lang == [model.langs[i] for i in want.argmax(axis=1)] and np.abs(score - p.max(axis=1)).max() < 0.05


def test_every_language_is_learned(spark):
    rows = [(100 * i + j, f"{chr(0x0391 + i % 20)}{chr(0x3041 + i)}{chr(0x4e00 + 7 * i)} " * 4 + chr(0x3041 + i) * (j + 1), f"l{i:03d}") for i in range(80) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True))
    assert len(model.langs) == 80
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()}
    assert sum(got[i] == x for i, _, x in rows) >= 0.95 * len(rows)
