"""Operator 2: benchmark decontamination by the q-gram lemma.

Texts are compared in a folded form: lower-cased letters and digits, every
run of anything else one blank.  An item of folded length m matches a region
of a document if their edit distance is at most e = floor(edits * m).  Such a
region shares at least m + 1 - q (e + 1) character q-grams with the item, all
on diagonals at most e apart.  So, for every document: look its q-grams up in
the items' q-grams, count the shared ones per item and diagonal band (bands
of width 2w that overlap by half, w = e + 1 of the item, so any e + 1
diagonals lie in one band), keep bands that reach the bound, and verify each
by alignment within the band (free start and end in the document).

The benchmark is a reference set: tasks pack it into blocks of about
``block_chars`` characters, which are fetched, broadcast and held against all
documents one after the other; with more than one, a block's matches are written
and its broadcast ended before the next one is fetched.  So the driver and the
tasks hold one block however large the benchmark is, and documents are read once
per block.

An item whose bound is below ``least_shared`` (too short, or too many edits
for its length) uses the largest e that keeps it there.  Items of fewer than
q + least_shared - 1 folded characters match exactly, between word ends; those
of fewer than ``whole_below`` only a text that holds nothing else, since a word
such as "yes" is no sign of contamination.

With ``part_words``, a passage of a longer item matches as well: the item's
overlapping parts of that many words (each begins part_words // 2 words after
the one before) are searched beside the whole item, each with an e, bound and
bands of its own, so that every passage of 1.5 times as many words holds one;
shorter passages of longer items are not looked for.
The parts of an item that overlap or touch in a document are one match, with
the most edits and the fewest shared q-grams among them; parts inside a match
of the whole item are that match.

Edge cases: null and empty texts and items match nothing; repeated items and
rows each match; a null item id is reported as null; a null document id too;
texts of any length count whole; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from valuemarts.llm.common import U64, Scratch, arrow_map, mix64, span_hash, strings
from valuemarts.llm.pretoken import LETTER, NUMBER, classes, code_points

TABLE_BITS = 20
#: words of the parts that the query and the pipeline search
PASSAGE_WORDS = 13
#: folded characters below which an item matches whole texts only
WHOLE_BELOW = 12


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded code points, offsets, position of each in its own text)."""
    low = [t.lower() if len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts]
    cp, off = code_points(low)
    g = classes()[cp]
    word = (g == LETTER) | (g == NUMBER)
    keep = word.copy()
    keep[1:] |= word[:-1]                     # the first of a run of others stands for a blank
    first = off[:-1][off[:-1] < off[1:]]
    keep[first] = word[first]
    at = np.flatnonzero(keep)
    new = np.searchsorted(at, off)
    out = np.where(word[at], cp[at], np.uint32(32))
    return out, new, at - np.repeat(off[:-1], np.diff(new))


def grams(cp: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q code points that begin at each position."""
    n = max(len(cp) - q + 1, 0)
    code = mix64(cp.astype(U64) + U64(1))
    out, width = code, 1
    parts, need, done = np.zeros(n, U64), q, 0
    while need:                               # powers of two, as in binary exponentiation
        if need & 1:
            parts = mix64(parts * U64(3) + out[done:done + n])
            done += width
        need >>= 1
        if need:
            out = mix64(out[:-width] * U64(5) + out[width:]) if len(out) > width else out[:0]
            width *= 2
    return parts


@dataclass
class Items:
    """A block of benchmark items, folded, with the index of their q-grams."""

    q: int
    ids: list
    texts: list[np.ndarray]
    budget: np.ndarray            # e of each item
    bound: np.ndarray             # shared q-grams that a match has at least
    key: np.ndarray               # q-gram hashes, ascending
    item: np.ndarray
    pos: np.ndarray
    seen: np.ndarray              # bitmap over hash prefixes
    width: np.ndarray             # w of each item
    whole: np.ndarray             # false for a part of an item
    owner: np.ndarray             # number of the item in the block
    all_ids: list                 # ids of the block's items
    short: dict[int, dict[bytes, list[int]]]     # folded length -> text -> numbers of items too short for q-grams


def index_items(ids: list, texts: list[str], q: int, edits: float, least_shared: int, part_words: int,
                with_whole: bool = False) -> Items:
    own, parts, whole, owner = [], [], [], []
    short: dict[int, dict[bytes, list[int]]] = {}
    for n, (i, t) in enumerate(zip(ids, texts)):
        cp, _, _ = fold([t or ""])
        cp = cp[:-1] if len(cp) and cp[-1] == 32 else cp
        if 0 < len(cp) < least_shared + q - 1:
            short.setdefault(len(cp), {}).setdefault(cp.astype("<u4").tobytes(), []).append(n)
            continue
        ends = np.flatnonzero(np.append(cp, np.uint32(32)) == 32)
        if part_words and len(ends) > part_words:
            begins = np.append(0, ends[:-1] + 1)
            step = max(part_words // 2, 1)
            marks = sorted({*range(0, len(ends) - part_words, step), len(ends) - part_words})
            cuts = [cp[begins[a]:ends[a + part_words - 1]] for a in marks]
            if with_whole:
                cuts.append(cp)
        else:
            cuts = [cp]
        for c in cuts:
            if len(c) + 1 - q >= least_shared:
                own.append(i)
                parts.append(c)
                whole.append(len(c) == len(cp))
                owner.append(n)
    m = np.array([len(c) for c in parts], dtype=np.int64)
    e = np.minimum((edits * m).astype(np.int64), np.maximum((m + 1 - least_shared) // q - 1, 0))
    hashes = [grams(c, q) for c in parts]
    key = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    item = np.repeat(np.arange(len(parts)), [len(h) for h in hashes])
    pos = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    seen = np.zeros(1 << TABLE_BITS, dtype=bool)
    seen[(key >> U64(64 - TABLE_BITS)).astype(np.int64)] = True
    return Items(q, own, parts, e, m + 1 - q * (e + 1), key[order], item[order], pos[order], seen, e + 1,
                 np.array(whole, dtype=bool), np.array(owner, dtype=np.int64), ids, short)


def align(items: list[np.ndarray], regions: list[np.ndarray], low: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """For each item and region the least edit distance of the whole item to a
    part of the region, with alignments kept to diagonals low .. low + width:
    (distance, start, end); ties go to the shortest, then the leftmost part.
    All pairs advance together, one item character at a time."""
    count = len(items)
    m = np.array([len(x) for x in items])
    n = np.array([len(x) for x in regions])[:, None]
    a = np.zeros((count, m.max()), dtype=np.uint32)
    r = np.zeros((count, n.max() + 1), dtype=np.uint32)
    for c in range(count):
        a[c, :m[c]], r[c, :n[c, 0]] = items[c], regions[c]
    big = int(m.max() + n.max() + 1)
    k = np.arange(width + 1)[None, :]
    first = low[:, None] + k                             # column of row 0 on each diagonal
    ok = (first >= 0) & (first <= n)
    cost, begin = np.where(ok, 0, big), np.where(ok, first, 0)
    end_cost, end_begin = cost.copy(), begin.copy()
    row = np.arange(count)[:, None]
    for i in range(1, int(m.max()) + 1):
        col = first + i
        ok = (col >= 0) & (col <= n)
        sub = np.where((col >= 1) & (col <= n), cost + (r[row, np.clip(col - 1, 0, r.shape[1] - 1)] != a[:, i - 1:i]), big)
        skip, back = np.full_like(cost, big), np.zeros_like(begin)      # an item character without partner
        skip[:, :-1], back[:, :-1] = cost[:, 1:] + 1, begin[:, 1:]
        take = skip < sub
        new, source = np.where(ok, np.where(take, skip, sub), big), np.where(take, back, begin)
        edge = col == 0                                  # the item begins before the region
        new, source = np.where(edge, np.minimum(new, i), new), np.where(edge, 0, source)
        lead = new - k                                   # document characters without partner
        best = np.minimum.accumulate(lead, axis=1)
        where = np.maximum.accumulate(np.where(lead == best, k, 0), axis=1)
        cost = np.where(ok, np.minimum(best + k, big), big)
        begin = np.take_along_axis(source, where, axis=1)
        last = m == i
        if last.any():
            end_cost[last], end_begin[last] = cost[last], begin[last]
    end = first + m[:, None]
    out = []
    for c in range(count):
        b = np.lexsort((end_begin[c], end[c] - end_begin[c], end_cost[c]))[0]
        out.append((int(end_cost[c, b]), int(end_begin[c, b]), int(end[c, b])))
    return out


def candidates(items: Items, texts: list[str], most: int = 1 << 19) -> list[tuple]:
    """(text, item, shared q-grams, folded region, its positions in the text
    as given, lowest diagonal in the region) of the bands that reach the bound.
    Texts with more than ``most`` hits in all are taken in halves."""
    cp, off, at = fold(texts)
    q, w = items.q, items.width
    if not len(items.texts):
        return []
    h = grams(cp, q)
    hot = np.flatnonzero(items.seen[(h >> U64(64 - TABLE_BITS)).astype(np.int64)])
    lo = np.searchsorted(items.key, h[hot])
    hit = lo < len(items.key)
    hot, lo = hot[hit], lo[hit]
    hit = items.key[lo] == h[hot]
    hot, lo = hot[hit], lo[hit]
    doc = np.searchsorted(off, hot, side="right") - 1
    inside = hot + q <= off[doc + 1]
    hot, lo, doc = hot[inside], lo[inside], doc[inside]
    if not len(hot):
        return []
    n = np.searchsorted(items.key, h[hot], side="right") - lo
    if n.sum() > most and len(texts) > 1:
        half = len(texts) // 2
        del cp, off, at, h, hot, lo, doc, hit, inside, n
        return candidates(items, texts[:half], most) + [(c[0] + half, *c[1:]) for c in candidates(items, texts[half:], most)]
    rep = np.repeat(np.arange(len(hot)), n)
    entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    # a pair with fewer hits in all than its bound has no band that reaches it
    _, pair, times = np.unique(doc[rep] * len(items.texts) + items.item[entry], return_inverse=True, return_counts=True)
    enough = times[pair] >= items.bound[items.item[entry]]
    rep, entry = rep[enough], entry[enough]
    if not len(rep):
        return []
    item, j = items.item[entry], hot[rep] - off[doc[rep]]
    diagonal = j - items.pos[entry] + (1 << 40)
    out: dict[tuple[int, int, int], int] = {}
    for shift in (0, 1):                                  # bands 2w wide, overlapping by half
        band = (diagonal + shift * w[item]) // (2 * w[item])
        code = np.stack([doc[rep], item, band], axis=1)
        order = np.lexsort((j, band, item, doc[rep]))
        code, jj = code[order], j[order]
        new = np.append(True, (code[1:] != code[:-1]).any(axis=1))
        fresh = new | np.append(True, jj[1:] != jj[:-1])  # a document q-gram counts once
        head = np.flatnonzero(new)
        shared = np.add.reduceat(fresh, head)
        code = code[head]
        enough = shared >= items.bound[code[:, 1]]
        for c, s in zip(code[enough].tolist(), shared[enough].tolist()):
            out[c[0], c[1], (2 * c[2] - shift) * int(w[c[1]]) - (1 << 40)] = s
    res = []
    for (d, i, first), shared in sorted(out.items()):
        m, e = len(items.texts[i]), int(items.budget[i])
        a = max(first - e, 0)
        b = min(first + 2 * int(w[i]) + m + e + 1, int(off[d + 1] - off[d]))
        # copies, so that the chunk's arrays can go
        res.append((d, i, shared, cp[off[d] + a:off[d] + b].copy(), at[off[d] + a:off[d] + b].astype(np.int32), first - e - a))
    return res


def verify(items: Items, todo: list[tuple], group: int) -> list[tuple[int, int, int, int, int, int]]:
    """The candidates within their items' budgets, aligned."""
    hits = []
    todo.sort(key=lambda c: len(items.texts[c[1]]))       # like lengths align together
    for i in range(0, len(todo), group):
        part = todo[i:i + group]
        own = np.array([c[1] for c in part])
        got = align([items.texts[c[1]] for c in part], [c[3] for c in part], np.array([c[5] for c in part]),
                    2 * int((items.width[own] + items.budget[own]).max()))
        for c, (cost, x, y) in zip(part, got):
            if cost <= items.budget[c[1]] and y > x:
                hits.append((c[0], c[1], int(c[4][x]), int(c[4][y - 1]) + 1, cost, c[2]))
    return hits


def find(items: Items, texts: list[str], size: int = 1 << 19, group: int = 256) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, start, end, edits, shared q-grams) of every match: the best
    of each run of overlapping regions of one item; start and end are code
    points of the text as given."""
    hits, todo, held, i = [], [], 0, 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= size):
            total += len(texts[j])
            j += 1
        new = [(i + c[0], *c[1:]) for c in candidates(items, texts[i:j])]
        todo, held, i = todo + new, held + sum(len(c[3]) for c in new), j
        if held > 4 * size:                               # regions held at a time
            hits += verify(items, todo, group)
            todo, held = [], 0
    hits += verify(items, todo, group)
    found: list[tuple[int, int, int, int, int, int]] = []
    for h in sorted(hits):
        if found and found[-1][:2] == h[:2] and h[2] < found[-1][3]:
            if h[4] < found[-1][4]:
                found[-1] = h
        else:
            found.append(h)
    return found


def find_short(items: Items, texts: list[str], whole_below: int = 0, size: int = 1 << 19) -> list[tuple[int, int, int, int, int, int]]:
    """(text, number of the item, start, end, 0, shared q-grams) of every place
    between word ends where a short item stands."""
    res: list[tuple[int, int, int, int, int, int]] = []
    keys = {m: np.sort(span_hash(np.concatenate([np.frombuffer(t, "<u4") for t in known]), np.arange(len(known)) * m, np.arange(1, len(known) + 1) * m))
            for m, known in items.short.items()}
    i = 0
    while keys and i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= size):
            total += len(texts[j])
            j += 1
        cp, off, at = fold(texts[i:j])
        begin = np.append(True, cp[:-1] == 32) & (cp != 32) if len(cp) else np.zeros(0, bool)
        begin[off[:-1][off[:-1] < off[1:]]] = True
        start = np.flatnonzero(begin & (cp != 32))
        doc = np.searchsorted(off, start, side="right") - 1
        last = off[doc + 1]
        begins = off[:-1] + (cp[np.minimum(off[:-1], len(cp) - 1)] == 32) if len(cp) else off[:-1]      # past a first blank
        for m, key in keys.items():
            end = start + m
            ok = (end <= last) & ((end == last) | (cp[np.minimum(end, len(cp) - 1)] == 32))
            if m < whole_below:                    # the whole text, but for a last blank
                ok &= (start == begins[doc]) & (end >= last - (cp[np.maximum(last - 1, 0)] == 32))
            a, d = start[ok], doc[ok]
            hit = np.isin(span_hash(cp, a, a + m), key)
            for x, y in zip(a[hit].tolist(), d[hit].tolist()):
                for n in items.short[m].get(cp[x:x + m].astype("<u4").tobytes(), ()):
                    res.append((i + y, n, int(at[x]), int(at[x + m - 1]) + 1, 0, max(m + 1 - items.q, 0)))
        i = j
    return res


def join_parts(items: Items, found: list[tuple[int, int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """The matches of ``find`` with the number of the item instead of its part:
    whole matches, and runs of parts that lie outside of them."""
    wholes = sorted((h[0], int(items.owner[h[1]]), *h[2:]) for h in found if items.whole[h[1]])
    parts = sorted((h[0], int(items.owner[h[1]]), *h[2:]) for h in found if not items.whole[h[1]])
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for h in wholes:
        spans.setdefault(h[:2], []).append((h[2], h[3]))
    runs: list[tuple[int, int, int, int, int, int]] = []
    for h in parts:
        if any(a < h[3] and h[2] < b for a, b in spans.get(h[:2], ())):
            continue
        if runs and runs[-1][:2] == h[:2] and h[2] <= runs[-1][3] + 1:
            r = runs[-1]
            runs[-1] = (*r[:3], max(r[3], h[3]), max(r[4], h[4]), min(r[5], h[5]))
        else:
            runs.append(h)
    return wholes + runs


def matches(docs: DataFrame, benchmark: DataFrame, q: int = 12, edits: float = 0.08, least_shared: int = 12,
            part_words: int = 0, block_chars: int = 1 << 22, text: str = "text", key: str = "doc_id",
            item_text: str = "text", item_key: str = "item_id", whole_below: int = WHOLE_BELOW) -> DataFrame:
    """One row per match: id, item_id, start, end, edits, shared_qgrams."""
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("__text"))
    kind = src.schema["id"].dataType.simpleString()
    item_type = benchmark.schema[item_key].dataType
    b_type = to_arrow_type(item_type)
    schema = f"id {kind}, item_id {item_type.simpleString()}, start int, end int, edits int, shared_qgrams int"
    rows = benchmark.select(F.col(f"`{item_key}`").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).where("t is not null")

    def found(shared) -> DataFrame:
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            items = shared.value
            texts = strings(b.column(1))
            res = sorted(join_parts(items, find(items, texts)) + find_short(items, texts, whole_below))
            take = b.column(0).take(pa.array([r[0] for r in res], pa.int64()))
            cols = [pa.array([items.all_ids[r[1]] for r in res], b_type)] + [pa.array([r[k] for r in res], pa.int32()) for k in (2, 3, 4, 5)]
            return pa.RecordBatch.from_arrays([take, *cols], ["id", "item_id", "start", "end", "edits", "shared_qgrams"])

        return arrow_map(src, run, schema)

    with Scratch(spark, "decontaminate") as tmp:
        blocks, many = _blocks(rows, block_chars, tmp, b_type)
        out = None
        for ids, texts in blocks:
            shared = spark.sparkContext.broadcast(index_items(ids, texts, q, edits, least_shared, part_words, with_whole=True))
            one = found(shared)
            if many:
                one = tmp.write(one, "matches", keep=True)
                shared.unpersist()
            out = one if out is None else out.union(one)
    return out if out is not None else spark.createDataFrame([], schema)


def _blocks(rows: DataFrame, block_chars: int, tmp: Scratch, item_type: pa.DataType) -> tuple[Iterator[tuple[list, list]], bool]:
    """The benchmark's blocks (ids, texts), fetched one at a time, and whether
    there are several.  Tasks pack their rows; a small benchmark is one block."""
    size = rows.agg(F.sum(F.length("t"))).head()[0]
    if size is None:
        return iter(()), False
    if size <= block_chars:
        got = rows.orderBy("i", "t").collect()
        return iter([([r["i"] for r in got], [r["t"] for r in got])]), False

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(item_type)), pa.array([texts], pa.list_(pa.string()))], ["i", "t"])

        ids, texts, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if texts and held + len(t) > block_chars:
                    yield out()
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(t)
                held += len(t)
        if texts:
            yield out()

    kind = rows.schema["i"].dataType.simpleString()
    packed = tmp.write(rows.mapInArrow(pack, f"i array<{kind}>, t array<string>"), "blocks")
    return ((list(r["i"]), list(r["t"])) for r in packed.toLocalIterator()), True
