"""Operator 13: ranked lexical search by an exact sparse ball tree.

A document is a sparse vector of term impacts, an item a sparse vector of term
weights; the score is their inner product in integers.  Documents are dealt to
blocks of bounded size as they are read, each block gets a ball tree: a node has
a centre (the largest coordinates of its documents' mean) and a radius (the
largest distance of its documents to that centre).  No document x of a node
scores above q.c + |q| |x - c|, so a search that visits nodes best-first, by a
heap of these bounds, may stop at the first bound below the k-th best score it
has.  Bounds are computed in doubles and rounded up (the radius by the error of
its sums, the bound by a share and a unit), scores at the leaves are exact
64-bit integers, and a node is left out only if its bound is *below* the k-th
score, so ties are kept.  Both vectors are scaled per term (impacts by s,
weights by 1/s), which leaves inner products alone and makes the balls tighter.

Work is dealt by documents: a task keeps the k best of each item over all its
blocks (so later blocks start with a good threshold) and sends those; the k
best per item are taken of these.  Nothing is shuffled but these rows.  Items
are searched in batches of bounded size, packed by tasks and fetched one at a
time; the batch's terms, weights and items are what is broadcast, and only
these terms are indexed, which keeps vectors short and balls small.

``weight``: floor(1000 ln((2N + 2) / (2 df + 1))), in doubles; ``impact``:
(10^9 tf) div (1000 tf + 8 m) with m = 25 + (75 n N) div L.  N counts documents
with a term, L all their terms, n a document's, df documents that hold the term.

Edge cases: null and empty texts have no terms; they count nowhere and an item
without terms has no rows; a document with a null id counts in N, L and df but
is not returned; rows that share an id are documents of their own; equal scores
go by id; an item's repeated terms count each time; items with equal or null ids
are ranked row by row; other columns take no part; empty tables give an empty
result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valuemarts.llm.common import Scratch, ascii_words, chunks, flat_utf8, same_spans, span_hash, spread

#: separators of terms: ASCII bytes that are neither letters nor digits
_APART = np.ones(256, dtype=bool)
_APART[0x30:0x3A] = _APART[0x41:0x5B] = _APART[0x61:0x7B] = _APART[0x80:] = False

BLOCK_DOCS, BLOCK_POSTINGS, LEAF_DOCS, CENTRE_TERMS = 8192, 4_000_000, 64, 512
#: items and bytes of a batch
BATCH_ITEMS, BATCH_BYTES = 1024, 4 << 20


class Vocabulary:
    """Terms of a batch: found by hash, confirmed by their bytes."""

    def __init__(self, terms: list[bytes]):
        flat = np.frombuffer(b"".join(terms), np.uint8)
        off = np.zeros(len(terms) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in terms], out=off[1:])
        h = span_hash(flat, off[:-1], off[1:])
        order = np.argsort(h, kind="stable")
        self.flat, self.off, self.hash, self.term = flat, off, h[order], order
        self.repeated = int(np.count_nonzero(self.hash[1:] == self.hash[:-1]))

    def __len__(self) -> int:
        return len(self.term)

    def find(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Term number of each span, -1 for others."""
        out = np.full(len(start), -1, dtype=np.int64)
        if not len(self) or not len(start):
            return out
        h = span_hash(low, start, end)
        at = np.searchsorted(self.hash, h)
        live = np.flatnonzero(at < len(self))
        while len(live):                       # entries of equal hash follow each other
            live = live[self.hash[at[live]] == h[live]]
            t = self.term[at[live]]
            size = self.off[t + 1] - self.off[t]
            ok = size == end[live] - start[live]
            ok[ok] = same_spans(low, start[live][ok], self.flat, self.off[t[ok]], size[ok])
            out[live[ok]] = t[ok]
            live = live[~ok]
            at[live] += 1
            live = live[at[live] < len(self)]
        return out


@dataclass
class Batch:
    """Items of one batch: ids, their terms' numbers and counts, the vocabulary."""

    ids: list[int | None]
    terms: list[np.ndarray]
    counts: list[np.ndarray]
    words: Vocabulary


def term_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return ascii_words(raw, off, _APART)


def make_batch(ids: list[int | None], texts: list[str | None]) -> Batch:
    raw, off = flat_utf8(pa.array(texts, pa.string()))
    low, start, end, first = term_spans(raw, off)
    data = low.tobytes()
    number: dict[bytes, int] = {}
    own = []
    for i in range(len(ids)):
        c = Counter(number.setdefault(data[a:b], len(number)) for a, b in zip(start[first[i]:first[i + 1]].tolist(), end[first[i]:first[i + 1]].tolist()))
        own.append(c)
    return Batch(ids, [np.array(list(c), dtype=np.int64) for c in own], [np.array(list(c.values()), dtype=np.int64) for c in own], Vocabulary(list(number)))


# -- statistics ---------------------------------------------------------------

def _postings(raw: np.ndarray, off: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of terms of each text; text, term and tf of the postings)."""
    low, start, end, first = term_spans(raw, off)
    t = words.find(low, start, end)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    hit = np.flatnonzero(t >= 0)
    pair, tf = np.unique(doc[hit] * max(len(words), 1) + t[hit], return_counts=True)
    return np.diff(first), pair // max(len(words), 1), pair % max(len(words), 1), tf


def statistics(docs: DataFrame, batch, text: str = "text") -> tuple[int, int, np.ndarray]:
    """(N, L, df of the batch's terms) over all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = batch.value.words
        total = np.zeros(len(words) + 2, dtype=np.int64)
        for b in batches:
            raw, off = flat_utf8(b.column(0))
            for i, j in chunks(off, 1 << 23):
                n, _, t, _ = _postings(raw[off[i]:off[j]], off[i:j + 1] - off[i], words)
                total[:-2] += np.bincount(t, minlength=len(words))
                total[-2:] += (np.count_nonzero(n), int(n.sum()))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "c"])

    n_terms = len(batch.value.words)
    total = np.zeros(n_terms + 2, dtype=np.int64)
    rows = (docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "term bigint, c bigint")
            .groupBy("term").agg(F.sum("c").alias("c")))
    for r in rows.collect():                   # one row per term of the batch at most
        total[r.term] = r.c
    return int(total[-2]), int(total[-1]), total[:-2]


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)


def impacts(n: np.ndarray, tf: np.ndarray, doc: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = np.array([25 + 75 * int(x) * n_docs // n_terms for x in n], dtype=np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])


# -- tree ---------------------------------------------------------------------

@dataclass
class Tree:
    """Documents in tree order with their postings, and the nodes: range of
    documents, first child (-1: leaf; the second follows), sparse centre, radius."""

    ids: np.ndarray
    ptr: np.ndarray
    term: np.ndarray
    impact: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    radius: np.ndarray
    centre_ptr: np.ndarray
    centre_term: np.ndarray
    centre: np.ndarray

    FIELDS = (("ids", "<i8"), ("ptr", "<i8"), ("term", "<i4"), ("impact", "<i4"), ("low", "<i4"), ("high", "<i4"), ("child", "<i4"),
              ("radius", "<f8"), ("centre_ptr", "<i4"), ("centre_term", "<i4"), ("centre", "<f8"))


def build_tree(ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, scale: np.ndarray,
               leaf_docs: int = LEAF_DOCS, centre_terms: int = CENTRE_TERMS) -> Tree:
    """Tree of a block; postings are sorted by document, each has one or more."""
    n, width = len(ids), len(scale)
    ptr = np.searchsorted(doc, np.arange(n + 1))
    value = impact * scale[term]
    norm = np.add.reduceat(value * value, ptr[:-1])
    order = np.arange(n)
    nodes: list[list] = [[0, n, -1]]
    radius, centres = [], []
    at = 0
    while at < len(nodes):
        lo, hi, _ = nodes[at]
        own = order[lo:hi]
        size = ptr[own + 1] - ptr[own]
        rows = spread(ptr[own], size)
        t, v = term[rows], value[rows]
        head = np.concatenate([[0], np.cumsum(size)[:-1]])
        c = np.bincount(t, weights=v, minlength=width) / len(own)
        if width > centre_terms:
            c[np.argpartition(c, width - centre_terms)[:width - centre_terms]] = 0
        cc = float(c @ c)
        d2 = norm[own] - 2 * np.add.reduceat(v * c[t], head) + cc
        radius.append(math.sqrt(max(float(d2.max()), 0.0) + 1e-9 * (float(norm[own].max()) + cc)) * (1 + 1e-9))
        some = np.flatnonzero(c)
        centres.append((some, c[some]))
        if hi - lo > leaf_docs:
            far = np.zeros(width)

            def dots(i: int) -> np.ndarray:
                far[:] = 0
                far[term[ptr[i]:ptr[i + 1]]] = value[ptr[i]:ptr[i + 1]]
                return np.add.reduceat(v * far[t], head)

            a = int(own[np.argmax(d2)])
            to_a = dots(a)
            b = int(own[np.argmax(norm[own] - 2 * to_a)])
            half = (hi - lo) // 2
            order[lo:hi] = own[np.argpartition(dots(b) - to_a, half)]
            nodes[at][2] = len(nodes)
            nodes += [[lo, lo + half, -1], [lo + half, hi, -1]]
        at += 1
    low, high, child = np.array(nodes).T
    size = ptr[order + 1] - ptr[order]
    rows = spread(ptr[order], size)
    return Tree(ids[order], np.concatenate([[0], np.cumsum(size)]), term[rows], impact[rows], low, high, child, np.array(radius),
                np.concatenate([[0], np.cumsum([len(x) for x, _ in centres])]), np.concatenate([x for x, _ in centres]),
                np.concatenate([y for _, y in centres]))


def _scale(weight: np.ndarray, df: np.ndarray, n_docs: int) -> np.ndarray:
    """Scale of the impacts of each term; terms of weight 0 play no part."""
    return np.sqrt(np.maximum(weight, 0)) * (max(n_docs, 1) / np.maximum(df, 1)) ** 0.25


def build_index(docs: DataFrame, batch, n_docs: int, n_terms: int, df: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per block of documents: its tree, one binary column per array."""
    weight = weights(n_docs, df)
    scale = _scale(weight, df, n_docs)
    src = docs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n_held = [0, 0]

        def block() -> pa.RecordBatch:
            start = np.cumsum([0] + [len(h[0]) for h in held])
            tree = build_tree(np.concatenate([h[0] for h in held]), np.concatenate([h[1] + s for h, s in zip(held, start)]),
                              np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]), scale)
            held.clear()
            n_held[:] = 0, 0
            return pa.RecordBatch.from_arrays([pa.array([getattr(tree, f).astype(kind).tobytes()], pa.binary()) for f, kind in Tree.FIELDS],
                                              [f for f, _ in Tree.FIELDS])

        for b in batches:
            raw, off = flat_utf8(b.column(1))
            ids = b.column(0).to_numpy()
            for i, j in chunks(off, 1 << 23):
                n, doc, t, tf = _postings(raw[off[i]:off[j]], off[i:j + 1] - off[i], batch.value.words)
                x = impacts(n, tf, doc, n_docs, n_terms) if len(doc) else tf
                use = weight[t] > 0
                doc, t, x = doc[use], t[use], x[use]
                some, doc = np.unique(doc, return_inverse=True)
                for a in range(0, len(some), BLOCK_DOCS):
                    cut = slice(*np.searchsorted(doc, [a, a + BLOCK_DOCS]))
                    held.append((ids[i:j][some[a:a + BLOCK_DOCS]], doc[cut] - a, t[cut], x[cut]))
                    n_held[0] += len(held[-1][0])
                    n_held[1] += len(t[cut])
                    if n_held[0] >= BLOCK_DOCS or n_held[1] >= BLOCK_POSTINGS:
                        yield block()
        if n_held[0]:
            yield block()

    return src.mapInArrow(run, ", ".join(f"{f} binary" for f, _ in Tree.FIELDS))


# -- search -------------------------------------------------------------------

class Searcher:
    """The k best of each item of a batch over the trees it is given."""

    def __init__(self, batch: Batch, weight: np.ndarray, scale: np.ndarray, k: int):
        self.k = k
        self.best: list[list[tuple[int, int]]] = [[] for _ in batch.ids]     # heaps of (score, -id)
        self.terms = batch.terms
        self.values = [weight[t] * c for t, c in zip(batch.terms, batch.counts)]
        self.weight = np.zeros(len(weight), dtype=np.int64)
        self.width = len(weight)
        with np.errstate(divide="ignore", invalid="ignore"):
            back = np.where(scale > 0, 1 / scale, 0.0)
        self.scaled = np.zeros((len(batch.ids), self.width))
        for i, (t, v) in enumerate(zip(self.terms, self.values)):
            self.scaled[i, t] = v * back[t]
        self.norm = np.sqrt((self.scaled ** 2).sum(axis=1))
        self.visited = self.leaves = 0

    def bounds(self, tree: Tree) -> np.ndarray:
        """Upper bound of each item's score in each node, rounded up."""
        used, at = np.unique(tree.centre_term, return_inverse=True)
        centre = np.zeros((len(tree.radius), len(used)))
        centre[np.repeat(np.arange(len(tree.radius)), np.diff(tree.centre_ptr)), at] = tree.centre
        return (self.scaled[:, used] @ centre.T + self.norm[:, None] * tree.radius[None, :]) * (1 + 1e-6) + 1

    def search(self, tree: Tree) -> None:
        bound = self.bounds(tree)
        self.leaves += int((tree.child < 0).sum()) * len(self.best)
        child, low, high = tree.child.tolist(), tree.low.tolist(), tree.high.tolist()
        for i, best in enumerate(self.best):
            if not len(self.terms[i]):
                continue
            mine = bound[i]
            q = self.weight
            q[self.terms[i]] = self.values[i]
            heap = [(-mine[0], 0)]
            while heap:
                b, node = heapq.heappop(heap)
                if len(best) == self.k and -b < best[0][0]:
                    break
                if child[node] >= 0:
                    for c in (child[node], child[node] + 1):
                        heapq.heappush(heap, (-mine[c], c))
                    continue
                self.visited += 1
                lo, hi = low[node], high[node]
                p = tree.ptr[lo:hi + 1]
                score = np.add.reduceat(tree.impact[p[0]:p[-1]] * q[tree.term[p[0]:p[-1]]], p[:-1] - p[0])
                least = best[0][0] if len(best) == self.k else 1
                for j in np.flatnonzero(score >= least).tolist():
                    entry = (int(score[j]), -int(tree.ids[lo + j]))
                    if len(best) < self.k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            q[self.terms[i]] = 0


def search_index(index: DataFrame, batch, n_docs: int, df: np.ndarray, k: int) -> DataFrame:
    """(row, item_id, doc_id, score): the k best of each item per task."""
    weight = weights(n_docs, df)
    scale = _scale(weight, df, n_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for b in batches:
            for blobs in zip(*(c.to_pylist() for c in b.columns)):
                found = found or Searcher(batch.value, weight, scale, k)
                parts = {f: np.frombuffer(x, kind) for (f, kind), x in zip(Tree.FIELDS, blobs)}
                found.search(Tree(**parts | {"impact": parts["impact"].astype(np.int64)}))
        if found:
            rows = [(i, batch.value.ids[i], -d, s) for i, best in enumerate(found.best) for s, d in best]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["row", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, "row bigint, item_id bigint, doc_id bigint, score bigint")


def _batches(items: DataFrame, text: str, key: str, tmp: Scratch) -> Iterator[Batch]:
    """Batches of items, packed by tasks and fetched one at a time."""
    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for b in rows:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t or "")
                if len(ids) >= BATCH_ITEMS or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string()))], ["ids", "texts"])
                    ids, texts, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string()))], ["ids", "texts"])

    src = items.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    packed = tmp.write(src.mapInArrow(pack, "ids array<bigint>, texts array<string>"), "items")
    for r in packed.toLocalIterator():
        yield make_batch(list(r.ids), list(r.texts))


def rank(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", key: str = "doc_id", item_text: str = "text",
         item_key: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents."""
    spark = docs.sparkSession
    with Scratch(spark, "ball-tree") as tmp:
        out = []
        for part in _batches(items, item_text, item_key, tmp):
            batch = spark.sparkContext.broadcast(part)
            n_docs, n_terms, df = statistics(docs, batch, text)
            if not n_docs:
                continue
            index = build_index(docs, batch, n_docs, n_terms, df, text, key)
            found = search_index(index, batch, n_docs, df, k)
            best = Window.partitionBy("row").orderBy(F.col("score").desc(), "doc_id")
            found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            out.append(tmp.write(found.select("item_id", "rank", "doc_id", "score"), "found", keep=True))
            batch.unpersist()
        if not out:
            return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        result = out[0]
        for more in out[1:]:
            result = result.union(more)
        return result
