"""Operator 5: toxicity by a factorization machine over hashed terms.

Terms (runs of letters, lower-cased, and the first 4 and 5 bytes of longer
ones) are hashed to 2^17 buckets; a text is the set of its buckets.  score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>):
the pair term raises texts where, say, an insult meets a group mention.
Weights are learned on the driver from a bounded sample of labelled rows
(``max_positive`` and ``max_negative`` rows, chosen by a hash of the id);
the sampling rates are undone by weights, so the score is a probability.
Terms seen in fewer than ``min_rows`` sampled rows carry nothing; all others
are learned.  A term whose share of toxic rows differs from the rest by fewer
than ``min_z`` standard errors, such as a group mention as common in clean
texts, keeps a linear weight or factors only where their gradients, given all
other terms, reach ``min_z`` standard errors; it may have factors without a
linear weight.

Edge cases: null and empty texts score sigmoid(w0); a document with several
labels is toxic if one says so; null labels and null ids teach nothing; with
no labelled row the score is 0; texts of any length count whole; other
columns take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuemarts.llm.common import U64, arrow_map, chunks, flat_utf8, mix64, span_hash

BITS = 17
FACTORS = 4
PREFIXES = (4, 5)             # bytes
_INNER = np.zeros(258, dtype=bool)
_INNER[[*range(97, 123), *range(128, 256)]] = True       # letters; bytes of other scripts


def term_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets per text): the distinct term buckets of each text, ascending."""
    raw, off = flat_utf8(pc.utf8_lower(col.fill_null("") if col.null_count else col))
    keys, sizes = [], []
    for i, j in chunks(off):
        part, cut = raw[off[i]:off[j]], off[i:j + 1] - off[i]
        inside = np.zeros(len(part) + 2, dtype=bool)
        inside[1:-1] = _INNER[part]
        begin, stop = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        at = cut[1:-1]
        at = at[(at > 0) & (at < len(part))]
        begin[at], stop[at - 1] = inside[1:-1][at], inside[1:-1][at - 1]
        start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        row = np.searchsorted(cut, start, side="right") - 1
        keys_of = []
        for size in (None, *PREFIXES):             # whole words, then the beginnings of longer words
            use = slice(None) if size is None else np.flatnonzero(end - start > size)
            a = start[use]
            h = span_hash(part, a, end if size is None else a + size)
            if size is not None:
                h = mix64(h + U64(size))
            keys_of.append((row[use] << BITS) | (h >> U64(64 - BITS)).astype(np.int64))
        key = np.unique(np.concatenate(keys_of))
        sizes.append(np.bincount(key >> BITS, minlength=j - i))
        keys.append((key & ((1 << BITS) - 1)).astype(np.int32))
    n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return (np.concatenate(keys) if keys else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i+1]] along the first axis, zero where empty."""
    cum = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, dtype=np.float64, out=cum[1:])
    return cum[off[1:]] - cum[off[:-1]]


@dataclass
class FactorMachine:
    bias: float
    table: np.ndarray            # buckets x (linear weight, factors)

    def logits(self, idx: np.ndarray, off: np.ndarray) -> np.ndarray:
        use = (self.table != 0).any(axis=1)[idx]   # terms without weight and factors add nothing
        cut = np.concatenate([[0], np.cumsum(use)])[off]
        rows = self.table[idx[use]]
        s = _sums(rows, cut)
        return self.bias + s[:, 0] + 0.5 * ((s[:, 1:] ** 2).sum(axis=1) - _sums((rows[:, 1:] ** 2).sum(axis=1), cut))

    def score(self, idx: np.ndarray, off: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(idx, off), -30, 30)))


def train(idx: np.ndarray, off: np.ndarray, y: np.ndarray, weight: np.ndarray, min_rows: int = 5, min_z: float = 4.0,
          rounds: int = 80, batch: int = 1000, rate: float = 0.2, shrink: float = 2e-5, seed: int = 1) -> FactorMachine:
    """Minibatch AdaGrad on the weighted logistic loss over the frequent
    terms, with a proximal (soft-threshold) step on the linear weights and
    decay of the factors; terms that alone don't tell the classes apart have
    wider thresholds, on their factors as a group too."""
    rng = np.random.default_rng(seed)
    df = np.bincount(idx, minlength=1 << BITS)
    toxic = np.bincount(idx, weights=np.repeat(y, np.diff(off)), minlength=1 << BITS)
    p = y.mean()
    z = (toxic - df * p) / np.sqrt(np.maximum(df * p * (1 - p), 1e-9))
    ok = (df >= min_rows)[idx]
    off, idx = np.concatenate([[0], np.cumsum(ok)])[off], idx[ok]
    cols, idx = np.unique(idx, return_inverse=True)
    m = len(cols)
    weak = np.abs(z[cols]) < min_z
    w = np.zeros((m, 1 + FACTORS))
    w[:, 1:] = rng.normal(0, 0.02, (m, FACTORS))
    grad2 = np.full((m, 1 + FACTORS), 1e-3)
    prior = float((y * weight).sum() / max(weight.sum(), 1e-9))
    bias, bias2 = float(np.log((prior + 1e-4) / (1 - prior + 1e-4))), 1e-4
    for r in range(rounds):
        order = rng.permutation(len(y))
        for a in range(0, len(order), batch):
            rows = order[a:a + batch]
            lens = off[rows + 1] - off[rows]
            cut = np.concatenate([[0], np.cumsum(lens)])
            at = np.repeat(off[rows] - cut[:-1], lens) + np.arange(cut[-1])
            f = idx[at]
            x = w[f]
            s = _sums(x, cut)
            z = bias + s[:, 0] + 0.5 * ((s[:, 1:] ** 2).sum(axis=1) - _sums((x[:, 1:] ** 2).sum(axis=1), cut))
            e = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows])
            each = np.repeat(e, lens)
            g = np.empty_like(w)
            g[:, 0] = np.bincount(f, weights=each, minlength=m)
            total = np.repeat(s[:, 1:], lens, axis=0) - x[:, 1:]
            for k in range(FACTORS):
                g[:, 1 + k] = np.bincount(f, weights=each * total[:, k], minlength=m)
            g /= weight[rows].sum()
            g[:, 1:] += 1e-4 * w[:, 1:]
            grad2 += g * g
            step = rate / np.sqrt(grad2)
            w -= step * g
            # standard errors of the gradients over the whole sample
            scale = min_z * np.sqrt(len(rows) / len(y)) / weight[rows].sum()
            error = scale * np.sqrt(np.bincount(f, weights=each * each, minlength=m))
            w[:, 0] = np.sign(w[:, 0]) * np.maximum(np.abs(w[:, 0]) - step[:, 0] * np.where(weak, np.maximum(error, shrink), shrink), 0)
            error = scale * np.sqrt(np.bincount(f, weights=each * each * (total * total).sum(axis=1), minlength=m))
            size = np.sqrt((w[:, 1:] ** 2).sum(axis=1))
            w[:, 1:] *= np.where(weak, np.maximum(1 - step[:, 1:].mean(axis=1) * error / np.maximum(size, 1e-12), 0), 1)[:, None]
            gb = e.sum() / weight[rows].sum()
            bias2 += gb * gb
            bias -= rate * gb / np.sqrt(bias2)
    table = np.zeros((1 << BITS, 1 + FACTORS), dtype=np.float32)
    table[cols] = w
    return FactorMachine(float(bias), table)


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, text: str = "text", key: str = "doc_id",
        label: str = "toxic", max_positive: int = 5000, max_negative: int = 10000) -> FactorMachine:
    """Learn from labelled documents where ``train_rows`` (on the column ``doc_id``) holds."""
    known = (labels.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("__y"))
             .where(F.col("doc_id").isNotNull() & F.col("__y").isNotNull() & train_rows)
             .groupBy("doc_id").agg(F.max("__y").alias("__y")))
    counts = {bool(r["p"]): r["n"] for r in known.groupBy((F.col("__y") > 0).alias("p")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return FactorMachine(-30.0, np.zeros((1 << BITS, 1 + FACTORS), dtype=np.float32))
    scale = 1 << 30
    rate = {p: min(1.0, most / max(counts.get(p, 0), 1)) for p, most in ((True, max_positive), (False, max_negative))}
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(scale))
                         < F.when(F.col("__y") > 0, int(rate[True] * scale)).otherwise(int(rate[False] * scale)))
    # the chosen ids are bounded by max_positive + max_negative
    rows = (docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("__text"))
            .join(F.broadcast(chosen), "doc_id").select("doc_id", "__y", "__text"))

    def features(b: pa.RecordBatch) -> pa.RecordBatch:
        idx, off = term_sets(b.column(2))
        parts = [idx[x:y].tobytes() for x, y in zip(off[:-1], off[1:])]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(parts, pa.binary())], ["k", "y", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = arrow_map(rows, features, f"k {kind}, y int, x binary").toPandas().sort_values(["k", "x"], kind="stable")
    idx = np.frombuffer(b"".join(got["x"]), dtype=np.int32)
    off = np.concatenate([[0], np.cumsum([len(x) // 4 for x in got["x"]])]).astype(np.int64)
    y = (got["y"].to_numpy() > 0).astype(np.float64)
    return train(idx, off, y, np.where(y > 0, 1 / rate[True], 1 / rate[False]))


def predict(docs: DataFrame, model: FactorMachine, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)      # a table of fixed size
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        score = shared.value.score(*term_sets(b.column(len(keep))))
        return pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(score)], [*keep, "score"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return arrow_map(src, run, f"{types + ', ' if types else ''}score double")
