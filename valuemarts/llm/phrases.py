"""Operator 11: phrase collocations, counted in HAT-tries.

Texts are cut into pieces at punctuation and line breaks and these into words;
phrases are words that follow each other within a piece.  A word's id is a
64-bit hash of its language and bytes; the merge of the word counts compares
the words themselves, and should two share an id, everything is counted again
with other ids.  So ids stand for words exactly.

Counting.  A task counts id sequences in a HAT-trie: a shallow trie over word
ids whose leaves are open-addressing hash containers.  A container that grows
beyond ``BURST`` sequences bursts: its most frequent leading words get
containers of their own, one level deeper.  When a task holds more than ``HELD``
sequences it spills its largest subtrees whole, as sorted runs.  Runs are cut by
the partition of their sequences' prefix, dealt to it, and merged there by
sorting, so a sequence comes once from each run, not from each occurrence.

Two passes.  The first counts words and pairs; the second counts, for each
position, the window of up to five words that starts there: a window's prefixes
of three, four and five words are the phrases that start there.  A window ends
where a pair is not frequent, since no phrase that holds it can be; which pairs
are, a bitmap says that is at most ``MOST_BITS`` bits and may say yes wrongly,
which costs work but no result.  Windows are dealt by their first three words.
Those of hot pairs (1/256 of all words or more, so at most 256 pairs) are dealt
by all words, and their prefixes' counts summed by an aggregation.

Score: floor(1000 a n / (l r)) in 38-digit decimals, which hold 1000 a n up to
1e38.  Everything after the counts is joins and aggregations over
the frequent phrases.

Edge cases: null texts are empty, null languages ``und`` (together with rows
that say so); repeated rows count each time; a long text is read in parts that
end at a piece's end; ties go by the phrase's bytes; other columns take no
part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valuemarts.llm.common import U64, Scratch, ascii_words, chunks, flat_utf8, mix64, span_hash

#: bytes that end a piece, and those between words of a piece
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_APART = _ENDS.copy()
_APART[[0x20, 0x09]] = True

PART_BYTES = 1 << 22
BURST, HELD = 1 << 16, 1 << 20
MOST_BITS = 1 << 28
HOT_SHARE = 256
WORDS, PAIRS, WINDOWS, HOT = 0, 1, 2, 3


# -- words ----------------------------------------------------------------------

def parts(raw: np.ndarray, off: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, first row, end row); a text longer than ``size`` is
    cut after bytes that end a piece."""
    for i, j in chunks(off, size):
        if j - i > 1 or off[j] - off[i] <= size:
            yield raw[off[i]:off[j]], off[i:j + 1] - off[i], i, j
            continue
        a, end = int(off[i]), int(off[j])
        while a < end:
            b = min(a + size, end)
            while b < end:                         # the next end of a piece
                stop = np.flatnonzero(_ENDS[raw[b:b + size]])
                if len(stop):
                    b += int(stop[0]) + 1
                    break
                b = min(b + size, end)
            yield raw[a:b], np.array([0, b - a]), i, j
            a = b


def lang_seeds(langs: list[str], salt: int) -> np.ndarray:
    flat, off = flat_utf8(pa.array(langs, pa.string()))
    return mix64(span_hash(flat, off[:-1], off[1:]) + U64(salt * 0xD6E8FEB86659FD93 % (1 << 64)))


def words_of(raw: np.ndarray, off: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lowered bytes, start, end, id, text, joined) of the words; ``joined``:
    the next word follows in the same piece.  No id is 0."""
    low, start, end, first = ascii_words(raw, off, _APART)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    ids = mix64(span_hash(low, start, end) ^ seeds[doc]) if len(start) else np.zeros(0, U64)
    ids[ids == 0] = 1
    piece = np.cumsum(_ENDS[raw])[start] if len(start) else start
    joined = np.zeros(len(start), dtype=bool)
    joined[:-1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
    return low, start, end, ids, doc, joined


# -- HAT-trie -------------------------------------------------------------------

def row_hash(keys: np.ndarray) -> np.ndarray:
    h = mix64(keys[:, 0] + U64(0x2545F4914F6CDD1D))
    for c in range(1, keys.shape[1]):
        h = mix64((h ^ keys[:, c]) * U64(0x9E3779B97F4A7C15) + U64(c))
    return h


class Container:
    """Counts of id sequences in an open-addressing table."""

    def __init__(self, width: int):
        self.n, self.bits = 0, 10
        self.keys = np.zeros((512, width), U64)
        self.counts = np.zeros(512, np.int64)
        self.slots = np.full(1 << self.bits, -1, np.int32)

    def _grow(self, more: int) -> None:
        while (self.n + more) * 2 > len(self.slots):
            self.bits += 1
            self.slots = np.full(1 << self.bits, -1, np.int32)
            size = 1 << (self.bits - 1)
            keys, counts = np.zeros((size, self.keys.shape[1]), U64), np.zeros(size, np.int64)
            keys[:self.n], counts[:self.n] = self.keys[:self.n], self.counts[:self.n]
            self.keys, self.counts = keys, counts
            if (self.n + more) * 2 <= len(self.slots):
                slot = (row_hash(self.keys[:self.n]) >> U64(64 - self.bits)).astype(np.int64)
                left = np.arange(self.n)
                while len(left):
                    free = np.flatnonzero(self.slots[slot[left]] < 0)
                    at, one = np.unique(slot[left[free]], return_index=True)
                    self.slots[at] = left[free[one]]
                    keep = np.ones(len(left), bool)
                    keep[free[one]] = False
                    left = left[keep]
                    slot[left] = (slot[left] + 1) & (len(self.slots) - 1)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Add sequences; returns the rows that were new, in the order of their entries."""
        new = []
        for a in range(0, len(keys), 1 << 15):
            new.append(a + self._add(keys[a:a + (1 << 15)], counts[a:a + (1 << 15)]))
        return np.concatenate(new) if new else np.zeros(0, np.int64)

    def _add(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        self._grow(len(keys))
        slot = (row_hash(keys) >> U64(64 - self.bits)).astype(np.int64)
        entry = np.empty(len(keys), np.int64)
        left, new = np.arange(len(keys)), []
        while len(left):
            e = self.slots[slot[left]]
            free = np.flatnonzero(e < 0)
            if len(free):                          # one new entry per free slot
                at, one = np.unique(slot[left[free]], return_index=True)
                won = left[free[one]]
                number = np.arange(self.n, self.n + len(won))
                self.keys[number] = keys[won]
                self.slots[at] = number
                self.n += len(won)
                new.append(won)
                e = self.slots[slot[left]]
            same = (self.keys[e] == keys[left]).all(axis=1)
            entry[left[same]] = e[same]
            left = left[~same]
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
        self.counts[:self.n] += np.bincount(entry, counts, minlength=self.n).astype(np.int64)
        return np.concatenate(new) if new else np.zeros(0, np.int64)


class HatTrie:
    """Counts of id sequences of one width: containers under a trie that is
    as deep as the words are frequent."""

    def __init__(self, width: int, burst: int = BURST):
        self.width, self.burst = width, burst
        self.container = Container(width)
        self.children: dict[int, HatTrie] = {}

    @property
    def size(self) -> int:
        return self.container.n + sum(c.size for c in self.children.values())

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        if self.children:
            known = np.array(sorted(self.children), dtype=U64)
            at = np.minimum(np.searchsorted(known, keys[:, 0]), len(known) - 1)
            inside = known[at] == keys[:, 0]
            order = np.flatnonzero(inside)
            order = order[np.argsort(at[order], kind="stable")]
            cut = np.searchsorted(at[order], np.arange(len(known) + 1))
            for i, word in enumerate(known.tolist()):
                own = order[cut[i]:cut[i + 1]]
                if len(own):
                    self.children[word].add(keys[own, 1:], counts[own])
            keys, counts = keys[~inside], counts[~inside]
        self.container.add(keys, counts)
        if self.container.n > self.burst and self.width > 1:
            self._burst()

    def _burst(self) -> None:
        """Move the sequences of frequent leading words one level down."""
        keys, counts = self.container.keys[:self.container.n], self.container.counts[:self.container.n]
        lead, at, n = np.unique(keys[:, 0], return_inverse=True, return_counts=True)
        frequent = n >= max(self.burst // 64, 2)
        if not frequent.any():                     # too flat for a trie: a larger container
            self.burst *= 2
            return
        moved = frequent[at]
        self.container = Container(self.width)
        self.container.add(keys[~moved], counts[~moved])
        for word in lead[frequent].tolist():
            own = keys[:, 0] == U64(word)
            child = self.children.setdefault(word, HatTrie(self.width - 1, self.burst))
            child.add(keys[own, 1:], counts[own])

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """All sequences and counts, unsorted."""
        keys, counts = [self.container.keys[:self.container.n]], [self.container.counts[:self.container.n]]
        for word, child in self.children.items():
            k, c = child.take()
            keys.append(np.concatenate([np.full((len(k), 1), word, U64), k], axis=1))
            counts.append(c)
        return np.concatenate(keys), np.concatenate(counts)

    def spill(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Whole subtrees as sorted runs, the largest first, until ``keep``
        sequences are left; they leave the trie."""
        for word in sorted(self.children, key=lambda w: -self.children[w].size):
            if self.size <= keep:
                return
            k, c = self.children.pop(word).take()
            yield sorted_run(np.concatenate([np.full((len(k), 1), word, U64), k], axis=1), c)
        if self.size > keep:
            run = sorted_run(*self.take())
            self.container, self.children = Container(self.width), {}
            yield run


def sorted_run(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences in order, equal ones summed."""
    if not len(keys):
        return keys, counts
    order = np.lexsort(keys.T[::-1])
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    return keys[head], np.add.reduceat(counts, head)


# -- runs ------------------------------------------------------------------------

def _zip(*arrays: np.ndarray) -> bytes:
    body = b"".join([np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64).tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unzip(blob: bytes, *kinds) -> list[np.ndarray]:
    body = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(body, np.int64, n, 8).tolist(), 8 * (n + 1), []
    for kind, size in zip(kinds, sizes):
        out.append(np.frombuffer(body, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _deal(keys: np.ndarray, counts: np.ndarray, kind: int, by: int, n_parts: int) -> Iterator[tuple[int, int, bytes]]:
    """Records (part, kind, run) of a run, by the hash of its first ``by`` ids."""
    part = (row_hash(keys[:, :by]) >> U64(20)) % U64(n_parts)
    order = np.argsort(part, kind="stable")             # runs stay sorted within a part
    keys, counts, part = keys[order], counts[order], part[order]
    cut = np.searchsorted(part, np.arange(n_parts + 1, dtype=U64))
    for p in np.flatnonzero(np.diff(cut)).tolist():
        a, b = cut[p], cut[p + 1]
        yield p, kind, _zip(counts[a:b], *[keys[a:b, c] for c in range(keys.shape[1])])


def _records(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, run = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(run, pa.binary())], ["part", "kind", "run"])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """The runs of each part, by kind; rows come sorted by part."""
    now, held = None, {}
    for b in batches:
        for part, kind, run in zip(*(c.to_pylist() for c in b.columns)):
            if part != now and held:
                yield now, held
                held = {}
            now = part
            held.setdefault(kind, []).append(run)
    if held:
        yield now, held


def _merged(runs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    got = [_unzip(r, np.int64, *[U64] * width) for r in runs]
    keys = np.stack([np.concatenate([g[c + 1] for g in got]) for c in range(width)], axis=1)
    return sorted_run(keys, np.concatenate([g[0] for g in got]))


def _source(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))


def _read(batches: Iterator[pa.RecordBatch], salt: int) -> Iterator[tuple]:
    for b in batches:
        raw, off = flat_utf8(b.column(1))
        langs = b.column(0).to_pylist()
        seeds = lang_seeds(langs, salt)
        for part, cut, i, j in parts(raw, off, PART_BYTES):
            yield langs[i:j], *words_of(part, cut, seeds[i:j])


# -- first pass: words and pairs ---------------------------------------------------

class _Words:
    """Word counts with the words themselves."""

    def __init__(self):
        self.container, self.langs, self.words = Container(1), [], []

    def add(self, langs: list[str], low: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray, doc: np.ndarray) -> None:
        new = self.container.add(ids[:, None], np.ones(len(ids), np.int64))
        data = low.tobytes()
        self.words += [data[a:b] for a, b in zip(start[new].tolist(), end[new].tolist())]
        self.langs += [langs[d].encode() for d in doc[new].tolist()]

    def deal(self, n_parts: int) -> Iterator[tuple[int, int, bytes]]:
        n = self.container.n
        ids = self.container.keys[:n, 0]
        part = (row_hash(ids[:, None]) >> U64(20)) % U64(n_parts)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(n_parts + 1, dtype=U64))
        for p in np.flatnonzero(np.diff(cut)).tolist():
            own = order[cut[p]:cut[p + 1]]
            words, langs = [self.words[i] for i in own.tolist()], [self.langs[i] for i in own.tolist()]
            yield p, WORDS, _zip(ids[own], self.container.counts[own], np.array([len(w) for w in words], np.int64), np.array([len(x) for x in langs], np.int64),
                                 np.frombuffer(b"".join(words), np.uint8), np.frombuffer(b"".join(langs), np.uint8))


def _merge_words(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[tuple[bytes, bytes]], int]:
    """(ids, counts, (language, word) of each, words that share an id with another)."""
    ids, counts, names = [], [], []
    for r in runs:
        i, c, a, b, w, x = _unzip(r, U64, np.int64, np.int64, np.int64, np.uint8, np.uint8)
        ids.append(i)
        counts.append(c)
        w, x = w.tobytes(), x.tobytes()
        wa, xa = np.concatenate([[0], np.cumsum(a)]).tolist(), np.concatenate([[0], np.cumsum(b)]).tolist()
        names += [(x[p:q], w[s:t]) for p, q, s, t in zip(xa[:-1], xa[1:], wa[:-1], wa[1:])]
    i, c = np.concatenate(ids), np.concatenate(counts)
    order = np.argsort(i, kind="stable")
    i, c = i[order], c[order]
    head = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    names = [names[k] for k in order.tolist()]
    clash = sum(1 for a, b in zip(head.tolist(), np.append(head[1:], len(i)).tolist()) if b - a > 1 and any(names[k] != names[a] for k in range(a + 1, b)))
    return i[head], np.add.reduceat(c, head), [names[k] for k in head.tolist()], clash


def _first_pass(docs: DataFrame, least: int, salt: int, text: str, lang: str, n_parts: int) -> DataFrame:
    """(kind, ids, f, lang, word): words and pairs with f >= least, words of
    each language in all (no ids), and clashes of ids (no ids, no language)."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = _Words(), HatTrie(2)
        for langs, low, start, end, ids, doc, joined in _read(batches, salt):
            if not len(ids):
                continue
            words.add(langs, low, start, end, ids, doc)
            at = np.flatnonzero(joined)
            pairs.add(np.stack([ids[at], ids[at + 1]], axis=1), np.ones(len(at), np.int64))
            if pairs.size > HELD:
                for keys, counts in pairs.spill(HELD // 2):
                    yield _records(list(_deal(keys, counts, PAIRS, 2, n_parts)))
            if words.container.n > HELD // 2:
                yield _records(list(words.deal(n_parts)))
                words = _Words()
        for keys, counts in pairs.spill(0):
            yield _records(list(_deal(keys, counts, PAIRS, 2, n_parts)))
        if words.container.n:
            yield _records(list(words.deal(n_parts)))

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, ids: list, f: list, lang: list, word: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(f), pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(f, pa.int64()),
                                               pa.array(lang, pa.string()), pa.array(word, pa.string())], ["kind", "ids", "f", "lang", "word"])

        for _, runs in _in_order(batches):
            if WORDS in runs:
                ids, counts, names, clash = _merge_words(runs[WORDS])
                if clash:
                    yield out(WORDS, [None], [clash], [None], [None])
                total: dict[bytes, int] = {}
                for (x, _), c in zip(names, counts.tolist()):
                    total[x] = total.get(x, 0) + c
                yield out(WORDS, [None] * len(total), list(total.values()), [x.decode() for x in total], [None] * len(total))
                big = np.flatnonzero(counts >= least).tolist()
                yield out(WORDS, ids.view(np.int64)[big, None].tolist(), counts[big].tolist(), [names[k][0].decode() for k in big],
                          [names[k][1].decode("utf-8", "replace") for k in big])
            if PAIRS in runs:
                keys, counts = _merged(runs[PAIRS], 2)
                big = counts >= least
                n = int(big.sum())
                yield out(PAIRS, keys[big].view(np.int64).tolist(), counts[big].tolist(), [None] * n, [None] * n)

    return (_source(docs, text, lang).mapInArrow(send, "part int, kind int, run binary").repartition(n_parts, "part").sortWithinPartitions("part")
            .mapInArrow(receive, "kind int, ids array<bigint>, f bigint, lang string, word string"))


# -- second pass: windows of three to five words -------------------------------------

def _bitmap(pairs: DataFrame, n_pairs: int) -> np.ndarray:
    """Bits of the pairs' hashes, in a power of two of bits (``MOST_BITS`` at
    most); tasks make pieces of it, which are put side by side here."""
    bits = min(MOST_BITS, 1 << max(16, (16 * n_pairs - 1).bit_length()))
    piece = min(bits, 1 << 19)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).flatten().to_numpy().view(U64).reshape(-1, 2)
            at = (row_hash(ids) % U64(bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // piece), pa.array(at % piece)], ["piece", "bit"])

    def make(key, table):
        own = np.zeros(piece, np.uint8)
        own[table.column("bit").to_numpy()] = 1
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    rows = (pairs.select("ids").mapInArrow(slots, "piece bigint, bit bigint").distinct().groupBy("piece").applyInArrow(make, "piece bigint, bits binary"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r.piece * piece // 8:(r.piece + 1) * piece // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def windows_of(ids: np.ndarray, joined: np.ndarray, frequent: np.ndarray, longest: int) -> np.ndarray:
    """Windows of three words or more (0: no word) that start at the words;
    ``frequent``: bitmap of pairs."""
    n = len(ids)
    good = np.zeros(n, dtype=bool)
    at = np.flatnonzero(joined)
    if len(at):
        bit = row_hash(np.stack([ids[at], ids[at + 1]], axis=1)) % U64(8 * len(frequent))
        good[at] = (frequent[(bit >> U64(3)).astype(np.int64)] >> (7 - (bit & U64(7)).astype(np.uint8))) & 1
    run = np.zeros(n + longest, dtype=np.int64)          # good pairs in a row from here
    for i in range(1, longest):
        follow = np.concatenate([run[1:n + 1]])
        run[:n] = np.where(good, np.minimum(follow + 1, longest - 1), 0)
    start = np.flatnonzero(run[:n] >= 2)
    padded = np.concatenate([ids, np.zeros(longest, U64)])
    return np.stack([np.where(run[start] >= k, padded[start + k], U64(0)) for k in range(longest)], axis=1)


def _second_pass(docs: DataFrame, least: int, longest: int, salt: int, frequent, hot: np.ndarray, text: str, lang: str, n_parts: int) -> DataFrame:
    """(ids, f): phrases of three words or more; those of hot pairs in parts."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def deal(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            of_hot = np.isin(row_hash(keys[:, :2]), hot)
            return _records([*_deal(keys[~of_hot], counts[~of_hot], WINDOWS, 3, n_parts), *_deal(keys[of_hot], counts[of_hot], HOT, longest, n_parts)])

        trie = HatTrie(longest)
        for _, _, _, _, ids, _, joined in _read(batches, salt):
            w = windows_of(ids, joined, frequent.value, longest)
            if len(w):
                trie.add(w, np.ones(len(w), np.int64))
            if trie.size > HELD // 2:
                for run in trie.spill(HELD // 4):
                    yield deal(*run)
        for run in trie.spill(0):
            yield deal(*run)

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, runs in _in_order(batches):
            for kind, lowest in ((WINDOWS, least), (HOT, 1)):
                if kind not in runs:
                    continue
                keys, counts = _merged(runs[kind], longest)
                for k in range(3, longest + 1):
                    head = np.flatnonzero(np.concatenate([[True], (keys[1:, :k] != keys[:-1, :k]).any(axis=1)]))
                    f = np.add.reduceat(counts, head)
                    big = (f >= lowest) & (keys[head, k - 1] != 0)
                    rows = keys[head[big], :k].view(np.int64)
                    f = f[big]
                    for a in range(0, len(f), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(rows[a:a + 50_000].tolist(), pa.list_(pa.int64())), pa.array(f[a:a + 50_000])], ["ids", "f"])

    return (_source(docs, text, lang).mapInArrow(send, "part int, kind int, run binary").repartition(n_parts, "part").sortWithinPartitions("part")
            .mapInArrow(receive, "ids array<bigint>, f bigint"))


# -- collocations ----------------------------------------------------------------------

def _scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """(ids, lang, a, l, r, n, score) of the lowest-scoring cut of each phrase."""
    c = phrases.where("size(ids) >= 2").select("ids", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k"))
    c = c.withColumns({"left": F.expr("slice(ids, 1, k)"), "right": F.expr("slice(ids, k + 1, size(ids) - k)")})
    c = (c.join(phrases.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left")
         .join(phrases.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right"))
    c = c.withColumn("word", F.col("ids")[0]).join(words.select(F.col("id").alias("word"), "lang"), "word").join(totals, "lang")
    wide = {x: f"cast({x} as decimal(17,0))" for x in "anlr"}
    score = F.expr(f"cast(cast(1000 as decimal(4,0)) * ({wide['a']} * {wide['n']}) as decimal(38,0)) div cast({wide['l']} * {wide['r']} as decimal(38,0))")
    c = c.withColumn("score", score)
    least = F.min(F.struct("score", "k", "l", "r")).alias("s")
    return (c.groupBy("ids").agg(least, F.min("lang").alias("lang"), F.min("a").alias("a"), F.min("n").alias("n"))
            .select("ids", "lang", "a", "s.l", "s.r", "n", "s.score"))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top``
    phrases of 2 to ``longest`` words that occur ``least`` times or more."""
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(spark, "phrases") as tmp:
        for salt in range(8):
            first = tmp.write(_first_pass(docs, least, salt, text, lang, n_parts), "words-and-pairs")
            if not first.where("ids is null and lang is null").head(1):
                break
        else:
            raise RuntimeError("word ids clash under eight salts")
        words = first.where(f"kind = {WORDS} and ids is not null").select(F.col("ids")[0].alias("id"), "lang", "word", "f")
        pairs = first.where(f"kind = {PAIRS}").select("ids", "f")
        totals = tmp.write(first.where(f"kind = {WORDS} and ids is null").groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        n_words = totals.agg(F.sum("n")).head()[0] or 0
        n_pairs = pairs.count()
        phrases = words.select(F.array("id").alias("ids"), "f").unionByName(pairs)
        if longest > 2 and n_pairs:
            frequent = spark.sparkContext.broadcast(_bitmap(pairs, n_pairs))
            hot = pairs.where(F.col("f") * HOT_SHARE >= n_words).select("ids").collect()     # HOT_SHARE at most
            hot = row_hash(np.array([r.ids for r in hot], np.int64).view(U64).reshape(-1, 2)) if hot else np.zeros(0, U64)
            more = _second_pass(docs, least, longest, salt, frequent, hot, text, lang, n_parts)
            phrases = phrases.unionByName(more.groupBy("ids").agg(F.sum("f").alias("f")).where(F.col("f") >= least))
        phrases = tmp.write(phrases, "phrases")
        inner = F.expr("flatten(transform(sequence(1, size(ids) - 1), s -> transform(sequence(2, least(size(ids) - s + 1, size(ids) - 1)), m -> slice(ids, s, m))))")
        held = (phrases.where("size(ids) >= 3").select("f", F.explode(inner).alias("ids")).where("size(ids) >= 2")
                .groupBy("ids").agg(F.max("f").alias("longer")))
        kept = _scored(phrases, words, totals).join(held, "ids", "left").where("longer is null or longer < a")
        text_of = (kept.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
                   .groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")))
        kept = kept.join(text_of, "ids")
        order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
        some = Window.partitionBy("lang", F.pmod(F.xxhash64("ids"), F.lit(64))).orderBy(*order)      # 64 short lists per language
        kept = kept.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        return tmp.write(kept.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "ranked", keep=True)
