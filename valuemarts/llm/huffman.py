"""Canonical length-limited Huffman codes: code construction, bit packing and
table-driven decoding of many segments at once, in numpy."""

from __future__ import annotations

import numpy as np

W = np.uint64


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); symbols
    with count 0 get length 0, a lone symbol length 1."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    # each level: symbols and pairs of the level below, by weight; ``symbol`` marks the symbols
    level, marks = weight, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        pairs = level[:len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        at = np.argsort(both, kind="stable")
        level = both[at]
        marks.append(at < n)
    take, lengths = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for mark in reversed(marks):             # the lightest symbols taken at a level are its first ones
        m = int(mark[:take].sum())
        lengths[:m] += 1
        take = 2 * (take - m)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then by symbol."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if not len(order):
        return codes
    n = lengths[order].astype(np.int64)
    top = int(n[-1])
    # a code, left-aligned to the longest length, is the sum of the spans before it
    codes[order] = ((np.cumsum(1 << (top - n)) - (1 << (top - n))) >> (top - n)).astype(np.uint64)
    return codes


def pack(ids: np.ndarray, off: np.ndarray, codes: np.ndarray, lengths: np.ndarray,
         step: int) -> tuple[list[bytes], list[np.ndarray]]:
    """The bits of each sequence ids[off[i]:off[i+1]] as bytes, and the bit
    offset of every ``step``-th id (from the first)."""
    size = lengths[ids].astype(np.int64)
    cum = np.concatenate([[0], np.cumsum(size)])
    bits = cum[off[1:]] - cum[off[:-1]]
    base = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    at = cum[:-1] + np.repeat(base[:-1] * 8 - cum[off[:-1]], np.diff(off))
    words = np.zeros(int(base[-1]) // 8 + 2, dtype=W)
    if len(ids):
        w, room = at >> 6, 64 - (at & 63) - size
        code = codes[ids]
        over = room < 0
        part = np.where(over, code >> np.where(over, -room, 0).astype(W), code << np.where(over, 0, room).astype(W))
        head = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        words[w[head]] = np.bitwise_or.reduceat(part, head)
        o = np.flatnonzero(over)
        words[w[o] + 1] |= code[o] << (64 + room[o]).astype(W)
    raw = words.astype(">u8").tobytes()
    out = [raw[a:b] for a, b in zip(base[:-1].tolist(), base[1:].tolist())]
    checks = [at[a:b:step] - 8 * c for a, b, c in zip(off[:-1].tolist(), off[1:].tolist(), base[:-1].tolist())]
    return out, checks


class Decoder:
    """Table-driven decoder: the next ``top`` bits name symbol and length."""

    def __init__(self, lengths: np.ndarray):
        self.top = max(int(lengths.max()) if len(lengths) else 0, 1)
        codes = canonical(lengths).astype(np.int64)
        self.symbol = np.zeros(1 << self.top, dtype=np.int32)
        self.length = np.ones(1 << self.top, dtype=np.uint8)
        used = np.flatnonzero(lengths)
        n = lengths[used].astype(np.int64)
        begin, span = codes[used] << (self.top - n), 1 << (self.top - n)
        at = np.repeat(begin - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
        self.symbol[at], self.length[at] = np.repeat(used, span), np.repeat(n, span)

    def segments(self, raw: np.ndarray, bit: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Symbols of the segments that begin at the given bits, end to end;
        all segments advance together, one symbol at a time."""
        pad = np.zeros((len(raw) // 8 + 2) * 8, dtype=np.uint8)
        pad[:len(raw)] = raw
        words = pad.view(">u8").astype(W)
        begin = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(int(begin[-1]), dtype=np.int32)
        order = np.argsort(-count, kind="stable")        # segments that end leave from the back
        p, dest, left = bit[order].astype(np.int64), begin[:-1][order], count[order]
        down = W(64 - self.top)
        for i in range(int(count.max()) if len(count) else 0):
            live = int(np.searchsorted(-left, -i, side="left"))
            p, dest = p[:live], dest[:live]
            w, s = p >> 6, (p & 63).astype(W)
            window = (words[w] << s) | ((words[w + 1] >> W(1)) >> (W(63) - s))
            code = (window >> down).astype(np.int64)
            out[dest + i] = self.symbol[code]
            p = p + self.length[code]
        return out
