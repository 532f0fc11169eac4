"""Operator 1: byte-level BPE encoding and decoding.

Pre-tokens of a batch are found on one flat array; the distinct ones not seen
before are merged together in numpy rounds: all symbols of all words lie in
one array, each adjacent pair is looked up by binary search in the sorted
pair keys of the merge table, and each word merges its lowest-ranked pair
(every occurrence, left to right) until no pair is left.  A round costs the
whole word, so words of more than ``LONG`` bytes, which take as many rounds as
they hold different pairs, are merged pair by pair from a heap instead: after a
merge only the pairs beside it are looked up again.

Edge cases: a null text is the empty text with no ids; a special token's
string in a text is that token, as the tokenizers library does by default;
texts of any length are cut only where no pre-token crosses; repeated rows
each give a row; other columns take no part.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuemarts.llm.common import arrow_map, chunks, flat_utf8, strings
from valuemarts.llm.pretoken import TokenCache, safe_pieces

_NONE = np.iinfo(np.int32).max
#: bytes from which a word is merged from a heap
LONG = 512
#: bytes of text that are encoded at a time
SLICE = 1 << 18


def byte_symbols() -> dict[str, int]:
    """The public byte alphabet: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeModel:
    """A byte-level BPE vocabulary read from a tokenizer file's content."""

    def __init__(self, content: bytes, piece: int = 1 << 16):
        spec = json.loads(content)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        alphabet = byte_symbols()
        size = 1 + max([*vocab.values(), *self.special.values()])
        pieces = [b""] * size
        for tok, i in vocab.items():
            pieces[i] = bytes(alphabet[c] for c in tok)
        for tok, i in self.special.items():
            pieces[i] = tok.encode()
        self.piece_off = np.zeros(size + 1, dtype=np.int64)
        np.cumsum([len(p) for p in pieces], out=self.piece_off[1:])
        self.piece_bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.byte_id = np.array([vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], dtype=np.int64)
        self.shift = np.int64(size)
        key = np.array([vocab[a] * size + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank = key[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.size, self.piece = size, piece
        self.rank_of: dict[int, int] | None = None         # made for the first long word
        self.cache = TokenCache(self.merge)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids per word, ids of the words laid end to end)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lens = np.array([len(b) for b in raw], dtype=np.int64)
        if len(lens) and lens.max() > LONG:
            short = np.flatnonzero(lens <= LONG)
            n, flat = self.merge([words[i] for i in short.tolist()])
            parts = dict(zip(short.tolist(), np.split(flat, np.cumsum(n)[:-1]))) if len(short) else {}
            parts |= {i: self._merge_long(raw[i]) for i in np.flatnonzero(lens > LONG).tolist()}
            return np.array([len(parts[i]) for i in range(len(words))]), np.concatenate([parts[i] for i in range(len(words))])
        sym = self.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            key = sym[:-1] * self.shift + sym[1:]
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            rank = np.full(len(sym), _NONE, dtype=np.int32)
            rank[:-1] = np.where((self.pair_key[at] == key) & (word[1:] == word[:-1]), self.pair_rank[at], _NONE)
            head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(head, len(word)))
            low = np.repeat(np.minimum.reduceat(rank, head), size)
            live = low != _NONE
            if not live.all():
                done.append((word[~live], sym[~live]))
                sym, word, rank, low = sym[live], word[live], rank[live], low[live]
                if not len(sym):
                    break
            hit = rank == low
            # of overlapping hits (a run of one symbol) every second merges, from the left
            idx = np.arange(len(hit))
            run = idx - np.maximum.accumulate(np.where(hit, -1, idx))
            left = hit & (run % 2 == 1)
            sym[left] = self.merged[rank[left]]
            keep = np.append(True, ~left[:-1])
            sym, word = sym[keep], word[keep]
        if not done:
            return lens, np.zeros(0, np.int32)
        word = np.concatenate([w for w, _ in done])
        sym = np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        return np.bincount(word, minlength=len(words)), sym[order].astype(np.int32)

    def _merge_long(self, raw: bytes) -> np.ndarray:
        """Ids of one long word: its pairs in a heap by rank and place."""
        sym = self.byte_id[np.frombuffer(raw, dtype=np.uint8)]
        key = sym[:-1] * self.shift + sym[1:]
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        known = np.flatnonzero(self.pair_key[at] == key)
        heap = ((self.pair_rank[at[known]].astype(np.int64) << 40) | known).tolist()
        heapq.heapify(heap)
        if self.rank_of is None:
            self.rank_of = dict(zip(self.pair_key.tolist(), self.pair_rank.tolist()))
        rank_of, merged, shift = self.rank_of, self.merged, int(self.shift)
        n = len(raw)
        ids, after, before = sym.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        mask = (1 << 40) - 1
        while heap:
            x = heapq.heappop(heap)
            i, rank = x & mask, x >> 40
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of.get(ids[i] * shift + ids[j]) != rank:
                continue                               # one of the two was merged meanwhile
            ids[i] = new = int(merged[rank])
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank_of.get(new * shift + ids[k])
                if r is not None:
                    heapq.heappush(heap, (r << 40) | i)
            h = before[i]
            if h >= 0:
                r = rank_of.get(ids[h] * shift + new)
                if r is not None:
                    heapq.heappush(heap, (r << 40) | h)
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets per text)."""
        return encode_with(self.cache, self.special, self.split, texts, self.piece)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        lens = self.piece_off[ids + 1] - self.piece_off[ids]
        cum = np.cumsum(lens)
        at = np.repeat(self.piece_off[ids] - (cum - lens), lens) + np.arange(cum[-1] if len(cum) else 0)
        return self.piece_bytes[at].tobytes()


def encode_with(cache: TokenCache, special: dict[str, int], split, texts: list[str],
                piece: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts through a pre-token cache, with special tokens
    recognised in the text; texts are processed in pieces of bounded size."""
    parts: list[str] = []
    owner: list[int] = []
    token: list[int] = []                      # >= 0: the part is this special token
    for i, t in enumerate(texts):
        found = split.split(t) if split and any(s in t for s in special) else [t]
        for x in found:
            if x in special:
                parts.append("")
                owner.append(i)
                token.append(special[x])
                continue
            for p in ([x] if len(x) <= piece else safe_pieces(x, piece)):
                parts.append(p)
                owner.append(i)
                token.append(-1)
    ids: list[np.ndarray] = []
    lens = np.zeros(len(parts), dtype=np.int64)
    a = 0
    while a < len(parts):
        b, size = a, 0
        while b < len(parts) and (b == a or size + len(parts[b]) <= 2 * piece):
            size += len(parts[b])
            b += 1
        flat, off = cache.tokens(parts[a:b])
        n = np.diff(off)
        lone = [k for k in range(a, b) if token[k] >= 0]
        if lone:
            where = off[[k - a for k in lone]]
            flat = np.insert(flat, where, [token[k] for k in lone])
            n[[k - a for k in lone]] = 1
        ids.append(flat)
        lens[a:b] = n
        a = b
    count = np.bincount(np.array(owner, dtype=np.int64), weights=lens, minlength=len(texts)).astype(np.int64) if parts else np.zeros(len(texts), np.int64)
    return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(count)])


_MODELS: dict[bytes, BpeModel] = {}


def model_of(content: bytes) -> BpeModel:
    """One model per worker process and vocabulary file."""
    key = hashlib.sha256(content).digest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = BpeModel(content)
    return _MODELS[key]


def read_tokenizer(path: str) -> bytes:
    """The vocabulary file's content, read on the driver (a fixed file)."""
    with open(path, "rb") as f:
        return f.read()


def encode_batch(m: BpeModel, b: pa.RecordBatch, ids: bool) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, whose last column is the text, encoded in slices of
    ``SLICE`` bytes of text, so that a task holds no more than a slice's ids."""
    _, places = flat_utf8(b.column(b.num_columns - 1))
    for i, j in chunks(places, SLICE):
        rows = b.slice(i, j - i)
        flat, off = m.encode(strings(rows.column(b.num_columns - 1)))
        sha, back = [], []
        for x, y in zip(off[:-1].tolist(), off[1:].tolist()):
            part = flat[x:y]
            sha.append(hashlib.sha256(part.astype("<u4").tobytes()).hexdigest())
            back.append(hashlib.sha256(m.decode(part).decode("utf-8", "replace").encode()).hexdigest())
        cols = {"n_tokens": pa.array(np.diff(off)), "ids_sha256": pa.array(sha, pa.string()),
                "decoded_sha256": pa.array(back, pa.string())}
        if ids:
            cols["ids"] = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *cols.values()], [*b.schema.names[:-1], *cols])


def encode_texts(df: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 ids: bool = True) -> DataFrame:
    """Columns ``keep`` with n_tokens, ids (int array, if asked for),
    ids_sha256 of the ids as little-endian unsigned 32-bit integers, and
    decoded_sha256 of the text that the ids decode to."""
    content = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(content.value)
        for b in batches:
            yield from encode_batch(m, b, ids)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    schema = f"{types}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return src.mapInArrow(run, schema)


def decode_ids(df: DataFrame, tokenizer_path: str, ids: str = "ids", out: str = "text",
               keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and the text that the id arrays stand for (null: empty)."""
    content = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").cast("array<int>").alias("__ids"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = model_of(content.value)
        texts = [m.decode(np.array(x or [], dtype=np.int64)).decode("utf-8", "replace") for x in b.column(len(keep)).to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(texts, pa.string())], [*keep, out])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return arrow_map(src, run, f"{types}, `{out}` string")
