"""Operator 12: removal of long byte strings that an earlier document holds.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id.  Ranks of suffixes are refined by prefix doubling:
strings of h bytes are ranked first, pairs of ranks at an offset give ranks of
2h bytes, and suffixes that no other document shares leave after each round.
Two things keep the rounds small on whole corpora:

* the first h is half of ``length`` (``length // 2 + 1``, 26 of 50 bytes):
  shorter prefixes would drop hardly any suffix, and one doubling then passes
  the threshold;
* only *anchors* take part: of the ``length - h + 1`` places of a window at
  which a string of h bytes fits, the one with the smallest hash of its eight
  bytes (leftmost of ties).  The choice depends on the window's bytes alone, so
  equal windows have equal anchors; about one position in 13 is one.

Round one: each document sends the rank names (64-bit hashes) of its anchors
to the partition that owns the name; names that two texts share come back, all
other suffixes are unique and done.  Round two, over what is left: an anchor
stands for the run of windows that chose it, hence for one *context*, the bytes
from the first window's start to the last one's end.  Contexts go to their
name's partition and are sorted there with their ids: one that an earlier
document holds too is past the threshold with all its windows; where contexts
of one name differ, their windows are ranked by their ``length`` bytes.  Equal
hashes are confirmed by the bytes, so nothing is removed by a hash alone; names
only choose who is looked at.

Map-side: a task sends a name once however many of its documents hold it, and
of equal contexts in a piece of input only the least id's.  A name with more
than 64 different contexts in one piece is hot (the edge of a passage that many
documents hold): its windows are ranked one by one, by an aggregation over
their 128-bit digests, and its partition, told so, hands on what it has of it.

Copies: texts are told apart by a 64-bit digest, and of equal texts only the
one with the smallest id is searched; the others are covered by it wholly.

Partitions of both rounds hold 1/``spark.sql.shuffle.partitions`` of the
anchors.  Intermediate tables are written below the checkpoint folder.

Edge cases: null texts are empty; texts shorter than ``length`` keep all; rows
with a null id keep all and cover nothing; rows that share an id don't cover
each other, and rows that also share the text are judged alike; within one
document repeats stay; other columns take no part; an empty table gives an
empty result.  Spans and kept bytes may cut UTF-8 characters, so they are
binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuemarts.llm.common import U64, Scratch, arrow_map, chunks, flat_utf8, mix64, same_spans, span_hash, spread

#: bytes that are searched in one array; larger texts are cut into pieces
PIECE = 1 << 22
_POSITION = U64((1 << 26) - 1)
#: anchors that a task holds before it sends them
FLUSH_ANCHORS = 1_000_000
#: contexts of one name in a piece of input, beyond which the name is hot
LOCAL_CONTEXTS = 64


def anchors(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of all runs of windows, ascending."""
    k = length // 2 + 1
    places, n = length - k + 1, len(raw)
    m = n - length + 1
    if m <= 0:
        return (np.zeros(0, np.int64),) * 3
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    key = np.ndarray((n - k + 1,), "<u8", buffer=padded, strides=(1,)) * U64(0x9FB21C651E98DF25)
    key ^= key >> U64(32)
    key *= U64(0x9E3779B97F4A7C15)
    key &= ~_POSITION
    key |= np.arange(len(key), dtype=U64)
    width = 1
    while 2 * width <= places:                     # least key of ``width`` places, by doubling
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < places:
        key = np.minimum(key[:len(key) - (places - width)], key[places - width:])
    q = (key[:m] & _POSITION).astype(np.int64)
    crossing = np.zeros(m + 1, dtype=np.int32)
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    np.add.at(crossing, np.minimum(np.maximum(cut - length + 1, 0), m), 1)
    np.add.at(crossing, np.minimum(cut, m), -1)
    p = np.flatnonzero(np.cumsum(crossing[:-1]) == 0)
    if not len(p):
        return (np.zeros(0, np.int64),) * 3
    q = q[p]
    first = np.concatenate([[True], (q[1:] != q[:-1]) | (p[1:] != p[:-1] + 1)])
    at = np.flatnonzero(first)
    return q[at], p[at], p[np.append(at[1:], len(p)) - 1]


def pieces(raw: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, row of each text, position of the first byte in its
    text) of texts in arrays of bounded size; a longer text comes in pieces
    that overlap by ``length - 1`` bytes, so that each window is in one."""
    for i, j in chunks(off, PIECE):
        if off[j] - off[i] <= 2 * PIECE:
            yield raw[off[i]:off[j]], off[i:j + 1] - off[i], np.arange(i, j), 0
            continue
        for s in range(int(off[i]), int(off[j]), PIECE):
            e = min(s + PIECE + length - 1, int(off[j]))
            yield raw[s:e], np.array([0, e - s]), np.array([i]), s - int(off[i])


def text_hash(data: memoryview | bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _digests(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, h) of the rows with an id."""
    src = docs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raw, off = flat_utf8(b.column(1))
        data, at = memoryview(np.ascontiguousarray(raw)), off.tolist()
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([text_hash(data[p:q]) for p, q in zip(at[:-1], at[1:])], pa.int64())], ["id", "h"])

    return arrow_map(src, run, "id bigint, h bigint")


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, h, n, z): id, text digest, bytes, and the text's bytes compressed."""
    src = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raw, off = flat_utf8(b.column(1))
        data = memoryview(np.ascontiguousarray(raw))
        at = off.tolist()
        h = [text_hash(data[p:q]) for p, q in zip(at[:-1], at[1:])]
        z = [pa.compress(data[p:q], codec="zstd", asbytes=True) for p, q in zip(at[:-1], at[1:])]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(h, pa.int64()), pa.array(np.diff(off)), pa.array(z, pa.binary())],
                                          ["id", "h", "n", "z"])

    return arrow_map(src, run, "id bigint, h bigint, n bigint, z binary")


# -- round one: ranks of half the threshold ------------------------------------

class _Holders:
    """Anchor names of the texts that a task has read, and what it sends."""

    def __init__(self, parts: int):
        self.parts = parts
        self.clear()

    def clear(self) -> None:
        self.ids: list[int] = []
        self.hashes: list[int] = []
        self.seen: dict[int, int] = {}
        self.names: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.size = 0

    def row(self, key: int, h: int) -> int:
        """Number of the text, or -1 if an equal one is there (the least id stays)."""
        at = self.seen.get(h)
        if at is not None:
            self.ids[at] = min(self.ids[at], key)
            return -1
        self.seen[h] = len(self.ids)
        self.ids.append(key)
        self.hashes.append(h)
        return len(self.ids) - 1

    def add(self, names: np.ndarray, docs: np.ndarray) -> None:
        self.names.append(names)
        self.docs.append(docs)
        self.size += len(names)

    def flush(self) -> pa.RecordBatch | None:
        """Rows for the names' partitions, and the names that are shared here."""
        if not self.size:
            self.clear()
            return None
        g, d = np.concatenate(self.names), np.concatenate(self.docs)      # in the order of the texts
        order = np.argsort(g, kind="stable")
        new = np.concatenate([[True], (np.diff(g[order]) != 0) | (np.diff(d[order]) != 0)])
        order = order[new]                           # once per text
        sorted_g = g[order]
        head = np.flatnonzero(np.concatenate([[True], sorted_g[1:] != sorted_g[:-1]]))
        size = np.diff(np.append(head, len(order)))
        shared = np.repeat(size > 1, size)
        ids, hashes = np.array(self.ids, np.int64), np.array(self.hashes, np.int64)
        rows = [(self.parts + o, x) for o, x in _to_owners(sorted_g[shared], d[order[shared]], ids, hashes, self.parts)]
        known, alone = sorted_g[head[size > 1]], np.sort(order[~shared])
        g, d = g[alone], d[alone]
        part = ((g >> U64(32)) % U64(self.parts)).astype(np.uint16 if self.parts <= 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        g, d, part = g[order], d[order], part[order]
        cut = np.searchsorted(part, np.arange(self.parts + 1))
        known_part = (known >> U64(32)) % U64(self.parts)
        for p in range(self.parts):
            a, b = cut[p], cut[p + 1]
            flags = known[known_part == p] if len(known) else known
            if a < b or len(flags):
                rows.append((p, _pack(g[a:b], d[a:b], ids, hashes, flags)))
        self.clear()
        return _dealt(rows)


def _dealt(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    part, data = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(data, pa.binary())], ["part", "data"])


def _to_owners(code: np.ndarray, row: np.ndarray, ids: np.ndarray, hashes: np.ndarray, parts: int,
               mask: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """(owner, packed codes) for the partitions that gather the texts' codes
    again, by the texts' digests; ``row``: the text of each code, ``mask``:
    bytes that go with it."""
    owner = np.mod(hashes[row], parts)
    order = np.lexsort((row, owner))
    code, row, owner = code[order], row[order], owner[order]
    mask = np.zeros((len(code), 0), np.uint8) if mask is None else mask[order]
    cut = np.searchsorted(owner, np.arange(parts + 1))
    for o in np.flatnonzero(np.diff(cut)).tolist():
        a, b = cut[o], cut[o + 1]
        texts, count = np.unique(row[a:b], return_counts=True)
        body = b"".join([np.array([len(texts), b - a, mask.shape[1]], np.int64).tobytes(), ids[texts].tobytes(), hashes[texts].tobytes(),
                         count.astype(np.int64).tobytes(), code[a:b].tobytes(), mask[a:b].tobytes()])
        yield o, len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _gathered(blobs: list[bytes]) -> pa.RecordBatch:
    """(id, h, data): each text's codes, and after them the bytes that go with them."""
    ids, hashes, counts, codes, masks = [], [], [], [], []
    for blob in blobs:
        body = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
        m, n, width = np.frombuffer(body, np.int64, 3).tolist()
        at = 24
        for out, kind, size in ((ids, np.int64, m), (hashes, np.int64, m), (counts, np.int64, m), (codes, U64, n), (masks, np.uint8, n * width)):
            out.append(np.frombuffer(body, kind, size, at))
            at += out[-1].nbytes
        masks[-1] = masks[-1].reshape(n, width)
    i, h, code, mask = np.concatenate(ids), np.concatenate(hashes), np.concatenate(codes), np.concatenate(masks)
    order = np.lexsort((h, i))
    new = np.concatenate([[True], (np.diff(i[order]) != 0) | (np.diff(h[order]) != 0)])
    text = np.empty(len(i), np.int64)
    text[order] = np.cumsum(new) - 1
    i, h = i[order][new], h[order][new]
    of = np.repeat(text, np.concatenate(counts))
    order = np.argsort(of, kind="stable")
    code, mask = code[order], mask[order]
    cut = np.searchsorted(of[order], np.arange(len(i) + 1)).tolist()
    data = [code[a:b].tobytes() + mask[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
    return pa.RecordBatch.from_arrays([pa.array(i), pa.array(h), pa.array(data, pa.binary())], ["id", "h", "data"])


def _by_part(batches: Iterator[pa.RecordBatch], below: int | None = None) -> Iterator[tuple[int | None, list[bytes]]]:
    """(part, its data) of rows that come sorted by part; of parts from
    ``below`` on, single rows."""
    now, held = None, []
    for b in batches:
        for part, data in zip(*(c.to_pylist() for c in b.columns)):
            if below is not None and part >= below:
                yield part, [data]
                continue
            if part != now and held:
                yield now, held
                held = []
            now = part
            held.append(data)
    if held:
        yield now, held


def _gather(dealt: DataFrame, parts: int) -> DataFrame:
    """(id, h, data) from rows (part, data) of owners: one row per text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_part(batches):
            yield _gathered(blobs)

    owned = dealt.select(F.pmod("part", F.lit(parts)).alias("part"), "data")
    return owned.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "id bigint, h bigint, data binary")


def _pack(g: np.ndarray, d: np.ndarray, ids: np.ndarray, hashes: np.ndarray, flags: np.ndarray) -> bytes:
    docs, count = np.unique(d, return_counts=True)
    body = b"".join([np.array([len(docs), len(g), len(flags)], np.int64).tobytes(), ids[docs].tobytes(), hashes[docs].tobytes(),
                     count.astype(np.int32).tobytes(), g.tobytes(), flags.tobytes()])
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    body = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    docs, n, flags = np.frombuffer(body, np.int64, 3).tolist()
    out, at = [], 24
    for kind, size in ((np.int64, docs), (np.int64, docs), (np.int32, docs), (U64, n), (U64, flags)):
        out.append(np.frombuffer(body, kind, size, at))
        at += out[-1].nbytes
    return tuple(out)


def _merge(blobs: list[bytes], parts: int) -> Iterator[tuple[int, bytes]]:
    """The names of a part that different texts share, for the texts' owners."""
    got = [_unpack(b) for b in blobs]
    ids, hashes = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
    g = np.concatenate([x[3] for x in got])
    d = np.repeat(np.arange(len(ids)), np.concatenate([x[2] for x in got]))
    known = np.unique(np.concatenate([x[4] for x in got]))
    order = np.argsort(g, kind="stable")
    g, d = g[order], d[order]
    if not len(g):
        return
    head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    h = hashes[d]
    differ = np.minimum.reduceat(h, head) != np.maximum.reduceat(h, head)
    differ |= np.isin(g[head], known)
    keep = np.repeat(differ, np.diff(np.append(head, len(g))))
    yield from _to_owners(g[keep], d[keep], ids, hashes, parts)


def shared_names(docs: DataFrame, length: int, text: str, key: str) -> DataFrame:
    """(id, h, names): anchor names of a text that another text holds too."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = docs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    k, most = length // 2 + 1, FLUSH_ANCHORS

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Holders(parts)
        for b in batches:
            raw, off = flat_utf8(b.column(1))
            data, at, keys = memoryview(np.ascontiguousarray(raw)), off.tolist(), b.column(0).to_pylist()
            for part, cut, rows, skip in pieces(raw, off, length):
                if skip == 0:                          # a new text; the pieces of one stay together
                    if held.size >= most and (out := held.flush()) is not None:
                        yield out
                    own = np.array([held.row(keys[i], text_hash(data[at[i]:at[i + 1]])) for i in rows.tolist()], dtype=np.int64)
                q, _, _ = anchors(part, cut, length)
                doc = own[np.searchsorted(cut, q, side="right") - 1]
                q, doc = q[doc >= 0], doc[doc >= 0]
                held.add(span_hash(part, q, q + k), doc)
        if (out := held.flush()) is not None:
            yield out

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in _by_part(batches, parts):
            yield _dealt([(part, blobs[0])] if part >= parts else list(_merge(blobs, parts)))

    sent = src.mapInArrow(send, "part int, data binary")
    back = sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(receive, "part int, data binary")
    return _gather(back, parts).withColumnRenamed("data", "names")


# -- round two: contexts and windows -------------------------------------------

def _texts(zs: list[bytes], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join(pa.decompress(z, decompressed_size=n, codec="zstd", asbytes=True) if n else b"" for z, n in zip(zs, sizes))
    off = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=off[1:])
    return np.frombuffer(raw, np.uint8), off


def _pack_contexts(flat: np.ndarray, size: np.ndarray, anchor: np.ndarray, ids: np.ndarray, hashes: np.ndarray, marks: np.ndarray) -> bytes:
    body = b"".join([np.array([len(size), len(flat), len(marks)], np.int64).tobytes(), ids.tobytes(), hashes.tobytes(),
                     size.astype(np.int32).tobytes(), anchor.astype(np.int32).tobytes(), marks.tobytes(), flat.tobytes()])
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unpack_contexts(blob: bytes) -> tuple[np.ndarray, ...]:
    body = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n, m, marks = np.frombuffer(body, np.int64, 3).tolist()
    out, at = [], 24
    for kind, size in ((np.int64, n), (np.int64, n), (np.int32, n), (np.int32, n), (U64, marks), (np.uint8, m)):
        out.append(np.frombuffer(body, kind, size, at))
        at += out[-1].nbytes
    return tuple(out)


class _Ranked:
    """Contexts by (anchor name, context), the least id first: which of them an
    earlier document holds wholly (``whole``, confirmed by the bytes), and the
    others (``rest``) with their anchor groups."""

    def __init__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, name: np.ndarray, code: np.ndarray, ids: np.ndarray):
        self.order = np.lexsort((ids, code, name))
        g, c, i = name[self.order], code[self.order], ids[self.order]
        new_name = np.concatenate([[True], g[1:] != g[:-1]])
        head = np.flatnonzero(new_name | np.concatenate([[True], c[1:] != c[:-1]]))
        first = np.repeat(head, np.diff(np.append(head, len(g))))
        later = i > i[first]
        at = np.flatnonzero(later)
        p, q = self.order[at], self.order[first[at]]
        size = end[p] - start[p]
        ok = size == end[q] - start[q]
        ok[ok] = same_spans(raw, start[p][ok], raw, start[q][ok], size[ok])
        later[at] = ok
        self.whole, rest = self.order[later], np.flatnonzero(~later)
        self.rest = self.order[rest]
        group = np.cumsum(new_name) - 1
        self.group = group[rest]                       # anchor group of each of the rest
        self.names = g[np.flatnonzero(new_name)]
        context = np.zeros(len(g), np.int64)
        context[head] = 1
        self.contexts = np.bincount(group, context, minlength=len(self.names))     # distinct contexts of a group


def _masks(n: int, places: int) -> np.ndarray:
    return np.packbits(np.ones((n, places), np.uint8), axis=1)


def _windows(raw: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, start) of all windows of the contexts."""
    n = end - start - length + 1
    of = np.repeat(np.arange(len(n)), n)
    offset = spread(np.zeros(len(n), np.int64), n)
    return of, offset, start[of] + offset


def _in_text(code: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Codes of different texts told apart."""
    return mix64(code + (row.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))


_ROUND = "part int, id bigint, h bigint, code bigint, i int, data binary"
_FIELDS = ("part", "id", "h", "code", "i", "data")
_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())


def _round_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, _KINDS)], list(_FIELDS))


def _window_rows(raw: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray, hashes: np.ndarray, code: np.ndarray, length: int,
                 parts: int) -> Iterator[tuple]:
    """Rows of the windows of contexts of hot names, which are ranked one by one."""
    data = raw.tobytes()
    of, offset, at = _windows(raw, start, end, length)
    for x, i, p in zip(of.tolist(), offset.tolist(), at.tolist()):
        h = int(hashes[x])
        yield parts + h % parts, int(ids[x]), h, int(code[x : x + 1].view(np.int64)[0]), i, hashlib.blake2b(data[p:p + length], digest_size=16).digest()


def _slices(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of rows whose texts (sizes in ``column``) make about one piece."""
    total = np.cumsum(b.column(column).to_numpy())
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PIECE, side="right")))
        yield b.slice(i, j - i)
        i = j


def _send_contexts(found: DataFrame, length: int, parts: int) -> DataFrame:
    """Contexts of the anchors whose names are shared, dealt by the name.  Of
    equal contexts of a piece of input only the least id's goes out, the others
    are covered; a name with more than ``LOCAL_CONTEXTS`` contexts in a piece is
    hot, so its windows go out one by one and its partition is told."""
    k, places, most = length // 2 + 1, length - length // 2, LOCAL_CONTEXTS

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        doc_id, doc_h = b.column(0).to_numpy(), b.column(1).to_numpy()
        sizes, zs, lists = (b.column(c).to_pylist() for c in (2, 3, 4))
        mine = [np.frombuffer(x, U64) for x in lists]
        raw, off = _texts(zs, sizes)
        for part, cut, rows, _ in pieces(raw, off, length):
            q, p, r = anchors(part, cut, length)
            doc = rows[np.searchsorted(cut, q, side="right") - 1]
            name = span_hash(part, q, q + k)
            of = np.repeat(rows, [len(mine[i]) for i in rows.tolist()])
            known = np.sort(_in_text(np.concatenate([mine[i] for i in rows.tolist()]), of))
            own = _in_text(name, doc)
            keep = np.flatnonzero(known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own)
            if not len(keep):
                continue
            q, p, e, doc, name = q[keep], p[keep], r[keep] + length, doc[keep], name[keep]
            code = span_hash(part, p, e)
            _, one = np.unique(_in_text(code, doc), return_index=True)     # once per text
            q, p, e, doc, name, code = q[one], p[one], e[one], doc[one], name[one], code[one]
            ids, hashes = doc_id[doc], doc_h[doc]
            x = _Ranked(part, p, e, name, code, ids)
            out = [(parts + o, None, None, None, None, v) for o, v in _to_owners(code[x.whole], doc[x.whole], doc_id, doc_h, parts, _masks(len(x.whole), places))]
            hot = (x.contexts > most)[x.group]
            own = x.rest[hot]
            out += _window_rows(part, p[own], e[own], ids[own], hashes[own], code[own], length, parts)
            marks = x.names[x.contexts > most]
            mark_part = (marks >> U64(32)) % U64(parts)
            own = x.rest[~hot]
            to = (name[own] >> U64(32)) % U64(parts)
            own = own[np.lexsort((p[own], doc[own], to))]
            ends = np.searchsorted((name[own] >> U64(32)) % U64(parts), np.arange(parts + 1, dtype=U64))
            for t in range(parts):
                sel, flag = own[ends[t]:ends[t + 1]], marks[mark_part == t]
                if len(sel) or len(flag):
                    size = e[sel] - p[sel]
                    out.append((t, None, None, None, None, _pack_contexts(part[spread(p[sel], size)], size, q[sel] - p[sel], ids[sel], hashes[sel], flag)))
            yield _round_rows(out)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, 2):
                yield from run(part)

    return found.select("id", "h", "n", "z", "names").mapInArrow(every, _ROUND)


def _rank_contexts(sent: DataFrame, length: int, parts: int) -> DataFrame:
    """Verdicts (part, data: codes of contexts and the bits of their covered
    windows) and windows still to rank (id, h, code, i, data: their digest)."""
    k, places = length // 2 + 1, length - length // 2

    def merge(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        got = [_unpack_contexts(b) for b in blobs]
        ids, hashes, size, anchor, marks, raw = (np.concatenate([g[c] for g in got]) for c in range(6))
        if not len(ids):
            return
        end = np.cumsum(size, dtype=np.int64)
        start = end - size
        name, code = span_hash(raw, start + anchor, start + anchor + k), span_hash(raw, start, end)
        order = np.lexsort((hashes, ids))
        new = np.concatenate([[True], (np.diff(ids[order]) != 0) | (np.diff(hashes[order]) != 0)])
        text = np.empty(len(ids), np.int64)
        text[order] = np.cumsum(new) - 1
        text_id, text_h = ids[order][new], hashes[order][new]
        x = _Ranked(raw, start, end, name, code, ids)
        yield _round_rows([(o, None, None, None, None, v) for o, v in _to_owners(code[x.whole], text[x.whole], text_id, text_h, parts, _masks(len(x.whole), places))])
        hot = np.isin(x.names, marks)[x.group]
        own = x.rest[hot]
        rows = list(_window_rows(raw, start[own], end[own], ids[own], hashes[own], code[own], length, parts))
        for a in range(0, len(rows), 50_000):
            yield _round_rows(rows[a:a + 50_000])
        own = x.rest[~hot & (x.contexts > 1)[x.group]]
        if not len(own):
            return
        of, offset, at = _windows(raw, start[own], end[own], length)
        w, i, g = span_hash(raw, at, at + length), ids[own][of], name[own][of]
        order = np.lexsort((i, w, g))
        w, i, g, of, offset, at = w[order], i[order], g[order], of[order], offset[order], at[order]
        head = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (g[1:] != g[:-1])]))
        first = np.repeat(head, np.diff(np.append(head, len(w))))
        later = np.flatnonzero(i > i[first])
        later = later[same_spans(raw, at[later], raw, at[first[later]], np.full(len(later), length))]
        bits = np.zeros((len(own), places), np.uint8)
        bits[of[later], offset[later]] = 1
        some = np.flatnonzero(bits.any(axis=1))
        own = own[some]
        yield _round_rows([(o, None, None, None, None, v) for o, v in _to_owners(code[own], text[own], text_id, text_h, parts, np.packbits(bits[some], axis=1))])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for b in batches:
            part = b.column(0).to_numpy()
            yield b.filter(pa.array(part >= parts))
            for p, data in zip(*(c.to_pylist() for c in b.filter(pa.array(part < parts)).select([0, 5]).columns)):
                if p != now and blobs:
                    yield from merge(blobs)
                    blobs = []
                now = p
                blobs.append(data)
        if blobs:
            yield from merge(blobs)

    return sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(receive, _ROUND)


# -- the cut --------------------------------------------------------------------

def _removed(raw: np.ndarray, off: np.ndarray, length: int, verdicts: list[list[bytes]], late: list[list[dict]]) -> list[tuple[list[int], list[int]]]:
    """(starts, ends) of the maximal removed runs of each text."""
    places, n = length - length // 2, len(raw)
    width = (places + 7) // 8
    codes, masks = [], []
    for i, (found, more) in enumerate(zip(verdicts, late)):
        for v in found:
            m = len(v) // (8 + width)
            codes.append(_in_text(np.frombuffer(v, U64, m), np.full(m, i)))
            masks.append(np.unpackbits(np.frombuffer(v, np.uint8, m * width, 8 * m).reshape(m, width), axis=1, count=places))
        for x in more:
            codes.append(_in_text(np.array([x["code"]], np.int64).view(U64), np.array([i])))
            masks.append(np.zeros((1, places), np.uint8))
            masks[-1][0, x["offsets"]] = 1
    code, mask = np.concatenate(codes), np.concatenate(masks)
    order = np.argsort(code, kind="stable")
    code, mask = code[order], mask[order]
    edge = np.zeros(n + 1, dtype=np.int32)
    for part, cut, rows, skip in pieces(raw, off, length):
        _, p, r = anchors(part, cut, length)
        own = _in_text(span_hash(part, p, r + length), rows[np.searchsorted(cut, p, side="right") - 1])
        at = np.minimum(np.searchsorted(code, own), len(code) - 1)
        hit = np.flatnonzero(code[at] == own)
        x, offset = np.nonzero(mask[at[hit]])
        s = p[hit][x] + offset
        s = s[s <= r[hit][x]] + off[rows[0]] + skip
        edge += np.bincount(s, minlength=n + 1).astype(np.int32)
        edge -= np.bincount(s + length, minlength=n + 1).astype(np.int32)
    gone = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    turn = np.flatnonzero(gone[1:] != gone[:-1])
    start, end = turn[::2], turn[1::2]
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):      # a run may go on into the next text
        i, j = np.searchsorted(end, a, side="right"), np.searchsorted(start, b)
        out.append(((np.maximum(start[i:j], a) - a).tolist(), (np.minimum(end[i:j], b) - a).tolist()))
    return out


def remove_repeats(docs: DataFrame, length: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document row: id, n_bytes, spans (removed runs: start, end)
    and kept (the remaining bytes)."""
    if length < 16:
        raise ValueError("length must be 16 or more")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(spark, "suffix-dedup") as tmp:
        keyed = _keyed(docs, text, key)
        texts = tmp.write(_digests(docs, text, key).distinct(), "texts")
        least = texts.groupBy("h").agg(F.min("id").alias("least"))
        copies = tmp.write(texts.join(least, "h").select("id", "h", (F.col("id") > F.col("least")).alias("copy")), "copies")
        names = tmp.write(shared_names(docs, length, text, key), "names", codec="zstd")
        names = names.join(copies.where("not copy").select("id", "h"), ["id", "h"], "left_semi")
        found = keyed.where(f"n >= {length}").join(names, ["id", "h"])
        ranked = tmp.write(_rank_contexts(_send_contexts(found, length, parts), length, parts), "ranked", codec="zstd")
        window = ranked.where("code is not null").select("id", "h", "code", "i", F.col("data").alias("w"))
        first = window.groupBy("w").agg(F.min("id").alias("first"))
        late = (window.join(first, "w").where("id > first").groupBy("id", "h", "code").agg(F.collect_list("i").alias("offsets"))
                .groupBy("id", "h").agg(F.collect_list(F.struct("code", "offsets")).alias("late")))
        verdicts = _gather(ranked.where("code is null"), parts)
        marks = (verdicts.select("id", "h", F.col("data").alias("v"), F.lit(False).alias("copy"))
                 .unionByName(copies.where("copy").select("id", "h", F.lit(None).cast("binary").alias("v"), "copy"))
                 .groupBy("id", "h").agg(F.collect_list("v").alias("verdicts"), F.max("copy").alias("copy")))
        marks = tmp.write(marks.join(late, ["id", "h"], "full"), "marks", keep=True, codec="zstd")
        judged = keyed.join(marks, ["id", "h"], "left").select("id", "n", "z", "verdicts", "late", "copy")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in _slices(batch, 1):
                    ids, sizes, zs, found, more, copy = (c.to_pylist() for c in b.columns)
                    runs = [([0], [n]) if same and n >= length else ([], []) for n, same in zip(sizes, copy)]
                    data = [pa.decompress(z, decompressed_size=n, codec="zstd", asbytes=True) if n else b"" for n, z in zip(sizes, zs)]
                    some = [i for i, same in enumerate(copy) if not same and (found[i] or more[i])]
                    if some:
                        off = np.concatenate([[0], np.cumsum([sizes[i] for i in some])])
                        raw = np.frombuffer(b"".join(data[i] for i in some), np.uint8)
                        for i, run in zip(some, _removed(raw, off, length, [found[i] or [] for i in some], [more[i] or [] for i in some])):
                            runs[i] = run
                    spans = [[{"start": p, "end": q} for p, q in zip(s, e)] for s, e in runs]
                    kept = [b"".join(d[p:q] for p, q in zip([0, *e], [*s, n])) for d, n, (s, e) in zip(data, sizes, runs)]
                    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, kind), pa.array(kept, pa.binary())],
                                                     ["id", "n_bytes", "spans", "kept"])

        return judged.mapInArrow(cut, "id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
