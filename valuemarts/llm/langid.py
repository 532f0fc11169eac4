"""Operator 4: language identification with a string kernel.

Blended-spectrum presence kernel: a text is the set of its character 1- to
3-grams (letters lower-cased, everything else one blank), kept as a bit set
of hashed buckets; k(x, y) = |x & y| / sqrt(|x| |y|).  Nystroem landmarks
(a fixed number per language) span the feature space, and one-versus-rest
kernel ridge regression is solved there.  As k is linear in the bit sets, the
landmark products and the ridge weights multiply to one bucket-by-language
matrix, so a batch is scored by one matrix product.

Every language that a training row names is learned.  Learning takes a bounded
sample, chosen by a hash of the id: ``per_lang`` texts of each language, fewer
of each where the languages would make more than ``sample_rows`` together (at
least ``LEAST_ROWS``); likewise the landmarks.  The model holds 2^15 floats per
language.

Edge cases: a text that is null or has no letter is ``und`` with score 0; a
row with a null id or null language teaches nothing and is still scored; with
nothing to learn from every text is ``und``; a tie goes to the language that
sorts first; texts of any length count whole; other columns take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuemarts.llm.common import arrow_map, strings
from valuemarts.llm.pretoken import LETTER, classes, code_points

BITS = 15
LEAST_ROWS = 8
GRAMS = 3
UND = "und"


def bit_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x buckets 0/1 matrix of the grams present, has a letter)."""
    cp, off = code_points([f" {t.lower()} " for t in texts] + [" " * GRAMS])
    letter = classes()[cp] == LETTER
    code = np.where(letter, cp, np.uint32(32)) * np.uint32(0x9E3779B1)
    row = np.repeat(np.arange(len(texts) + 1, dtype=np.int64), np.diff(off))
    valid = np.ones(len(cp), dtype=bool)
    valid[off[1:] - 1] = False                     # no gram begins at the closing blank
    n = int(off[-2])
    valid, base = valid[:n], row[:n] << BITS
    out = np.zeros((len(texts), 1 << BITS), dtype=np.uint8)
    flat, gram = out.reshape(-1), np.zeros(len(cp), dtype=np.uint32)
    for k in range(GRAMS):
        gram[:n] = gram[:n] * np.uint32(0x85EBCA6B) + code[k:n + k]
        h = (gram[:n] ^ (gram[:n] >> np.uint32(15)) ^ np.uint32(k * 0x27D4EB2F)) * np.uint32(0xC2B2AE35)
        flat[(base + (h >> np.uint32(32 - BITS)))[valid]] = 1
    has = np.add.reduceat(letter, off[:-1])[:len(texts)] > 0 if len(texts) else np.zeros(0, bool)
    return out, has


def _groups(texts: list[str], rows: int = 256, size: int = 1 << 20):
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and j - i < rows and (j == i or total + len(texts[j]) <= size):
            total += len(texts[j])
            j += 1
        yield i, j
        i = j


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray          # buckets x languages

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, score of that language between 0 and 1) of each text."""
        lang, score = [], np.zeros(len(texts))
        for i, j in _groups(texts):
            x, has = bit_sets(texts[i:j])
            if not self.langs:
                lang += [UND] * (j - i)
                continue
            size = np.maximum(x.sum(axis=1, dtype=np.int64), 1)
            f = (x.astype(np.float32) @ self.weights) / np.sqrt(size)[:, None]
            p = np.exp(4 * (f - f.max(axis=1, keepdims=True)))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            lang += [self.langs[b] if ok else UND for b, ok in zip(best, has)]
            score[i:j] = np.where(has, p[np.arange(j - i), best], 0.0)
        return lang, score


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", key: str = "doc_id",
        per_lang: int = 500, landmarks: int = 80, sample_rows: int = 4000, ridge: float = 1e-2) -> LanguageModel:
    """Learn from the rows where ``train`` holds and the language is known."""
    rows = docs.where(train & F.col(f"`{lang}`").isNotNull() & F.col(f"`{key}`").isNotNull())
    counts = rows.groupBy(F.col(f"`{lang}`").cast("string").alias("l")).count().collect()      # one row per language
    names = sorted(r["l"] for r in counts)
    if not names:
        return LanguageModel([], np.zeros((1 << BITS, 0), dtype=np.float32))
    scale = 1 << 30
    per_lang = max(LEAST_ROWS, min(per_lang, sample_rows // len(names)))
    landmarks = max(LEAST_ROWS // 2, min(landmarks, sample_rows // 6 // len(names)))
    shares = docs.sparkSession.createDataFrame([(r["l"], int(min(1.0, per_lang / r["count"]) * scale)) for r in counts], "__share_of string, __share long")
    sample = (rows.select(F.col(f"`{key}`").alias("__k"), F.col(f"`{lang}`").cast("string").alias("__l"),
                          F.col(f"`{text}`").cast("string").alias("__t"))
              .join(F.broadcast(shares), F.col("__l") == F.col("__share_of"))          # one row per language
              .where(F.pmod(F.xxhash64("__k", F.lit(7)), F.lit(scale)) < F.col("__share")).select("__k", "__l", "__t"))

    def features(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, parts = strings(b.column(2)), []
        for i, j in _groups(texts):
            x, _ = bit_sets(texts[i:j])
            parts += [r.tobytes() for r in np.packbits(x, axis=1)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(parts, pa.binary())], ["k", "l", "x"])

    kind = sample.schema["__k"].dataType.simpleString()
    got = arrow_map(sample, features, f"k {kind}, l string, x binary").toPandas()
    got = got.sort_values(["l", "k", "x"], kind="stable").reset_index(drop=True)
    x = np.unpackbits(np.frombuffer(b"".join(got["x"]), dtype=np.uint8).reshape(len(got), -1), axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    y = np.where(got["l"].to_numpy()[:, None] == np.array(names)[None, :], 1.0, -1.0)
    marks = np.concatenate([np.flatnonzero(got["l"] == n)[:landmarks] for n in names])
    z = x[marks]
    val, vec = np.linalg.eigh((z @ z.T).astype(np.float64))
    ok = val > 1e-6 * val.max()
    half = vec[:, ok] / np.sqrt(val[ok])            # K_mm^(-1/2) on its range
    phi = (x @ z.T) @ half
    weight = 1.0 / np.sqrt(np.maximum((y > 0).sum(axis=0)[y.argmax(axis=1)], 1))   # languages count alike
    a = phi * weight[:, None]
    beta = np.linalg.solve(a.T @ a + ridge * np.trace(a.T @ a) / a.shape[1] * np.eye(a.shape[1]), a.T @ (y * weight[:, None]))
    return LanguageModel(names, (z.T @ (half @ beta)).astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
            prefix: str = "") -> DataFrame:
    """Columns ``keep`` with lang_pred and score (their names after ``prefix``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)      # buckets x languages
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = shared.value.predict(strings(b.column(len(keep))))
        return pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(lang, pa.string()), pa.array(score)],
                                          [*keep, f"{prefix}lang_pred", f"{prefix}score"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return arrow_map(src, run, f"{types + ', ' if types else ''}{prefix}lang_pred string, {prefix}score double")
