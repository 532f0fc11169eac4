"""Byte-level pre-tokens of many texts at once, and a bounded cache of the
ids of each distinct pre-token.

The split is the public byte-level BPE rule (contractions, letters, numbers
and other runs with one leading blank, white space), found on one flat array
of code points instead of text by text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

from valuemarts.llm.common import U64, same_spans, span_hash, spread

LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
_CLASS: list[np.ndarray] = []
#: fixed values: the contractions of the split rule
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def classes() -> np.ndarray:
    """Class of each code point, from the Unicode properties."""
    if not _CLASS:
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        points = np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")])
        every = points.tobytes().decode("utf-32-le")       # no object per code point
        for prop, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
            for m in regex.finditer(prop, every):
                a, b = ord(m[0][0]), ord(m[0][-1])
                table[a:b + 1] = value
        table[0xD800:0xE000] = OTHER
        _CLASS.append(table)
    return _CLASS[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of the texts laid end to end."""
    off = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), off


def token_starts(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Positions where pre-tokens begin, ascending."""
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64)
    g = classes()[cp]
    first = np.zeros(n + 1, dtype=bool)
    first[off] = True                      # position n: end of the last text
    start = np.empty(n, dtype=bool)
    start[0] = True
    ws, blank = g == SPACE, cp == 32
    np.not_equal(g[1:], g[:-1], out=start[1:])
    start[1:] &= ~blank[:-1]               # a blank joins what follows it
    # blank -> white space of the same class never differs, so nothing is lost
    inner = ws[1:-1] & ws[:-2] & ~ws[2:] & ~first[2:n] & ~first[1:n - 1]
    start[1:-1] |= inner                   # the last of a run of white space stands alone
    start |= first[:n]
    quote = np.flatnonzero(cp == 39)
    if len(quote):
        limit = off[np.searchsorted(off, quote, side="right")]      # end of the quote's text
        before = np.where(first[quote], 0, g[quote - 1])
        free = first[quote] | (before == LETTER) | (before == NUMBER) | ((before == SPACE) & ~blank[quote - 1])
        pad = np.concatenate([cp, np.zeros(3, np.uint32)])
        for word in CONTRACTIONS:
            k = len(word)
            hit = free & (quote + k <= limit)
            for i, ch in enumerate(word[1:], 1):
                hit &= pad[quote + i] == ord(ch)
            at = quote[hit]
            start[at + 1] = False
            after = at + k
            start[after[after < n]] = True
    return np.flatnonzero(start)


def safe_pieces(text: str, size: int) -> list[str]:
    """Cut a long text before single blanks between letters: no pre-token
    crosses such a cut, so the pieces' pre-tokens are the text's."""
    out, i = [], 0
    while len(text) - i > size:
        m = _CUT.search(text, i + size)
        if not m:
            break
        out.append(text[i:m.end()])
        i = m.end()
    out.append(text[i:])
    return out


_CUT = regex.compile(r"\p{L}(?= \p{L})")


class TokenCache:
    """ids of distinct pre-tokens, in a vectorised open-addressing table that
    starts afresh beyond ``limit`` entries (bounded memory).  Entries are found
    by hash and compared with the pre-token itself; one that only shares its
    hash with another is encoded by itself."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 1 << 19):
        self.encode, self.limit = encode, limit
        self.bits = (limit * 4 - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(1 << self.bits, dtype=U64)
        self.val = np.full(1 << self.bits, -1, dtype=np.int32)
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.off = np.zeros(1, dtype=np.int64)
        self.cp = np.zeros(1 << 16, dtype=np.uint32)     # the entries' code points
        self.cp_off = np.zeros(1, dtype=np.int64)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry or -1, slot where it is or would go)."""
        slot = (h >> U64(64 - self.bits)).astype(np.int64)
        v = self.val[slot]
        todo = np.flatnonzero((v >= 0) & (self.key[slot] != h))
        mask = (1 << self.bits) - 1
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            v[todo] = self.val[slot[todo]]
            todo = todo[(v[todo] >= 0) & (self.key[slot[todo]] != h[todo])]
        return v, slot

    @staticmethod
    def _put(store: np.ndarray, off: np.ndarray, lens: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(store, offsets) with the pieces of ``flat`` appended."""
        used = int(off[-1])
        if used + len(flat) > len(store):
            store = np.concatenate([store[:used], np.zeros(len(flat) + max(len(flat), used), store.dtype)])
        store[used:used + len(flat)] = flat
        return store, np.concatenate([off, used + np.cumsum(lens)])

    def _add(self, h: np.ndarray, lens: np.ndarray, flat: np.ndarray, cp_lens: np.ndarray, cp: np.ndarray) -> None:
        n = len(self.off) - 1
        self.ids, self.off = self._put(self.ids, self.off, lens, flat)
        self.cp, self.cp_off = self._put(self.cp, self.cp_off, cp_lens, cp)
        entry = np.arange(n, n + len(h), dtype=np.int32)
        left = np.arange(len(h))
        while len(left):
            _, slot = self._find(h[left])
            _, one = np.unique(slot, return_index=True)     # one new entry per free slot
            won = left[one]
            self.key[slot[one]], self.val[slot[one]] = h[won], entry[won]
            left = np.delete(left, one)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts laid end to end."""
        cp, off = code_points(texts)
        start = token_starts(cp, off)
        end = np.append(start[1:], len(cp))[:len(start)]
        h = span_hash(cp, start, end)
        v, _ = self._find(h)
        new = np.flatnonzero(v < 0)
        if len(new):
            if len(self.off) + len(new) > self.limit and len(self.off) > 1:
                self.clear()
                new = np.arange(len(h))
            _, one = np.unique(h[new], return_index=True)
            pick = new[one]
            joined = "".join(texts)
            lens, flat = self.encode([joined[a:b] for a, b in zip(start[pick].tolist(), end[pick].tolist())])
            size = end[pick] - start[pick]
            self._add(h[pick], lens, flat, size, cp[spread(start[pick], size)])
            v[new], _ = self._find(h[new])
        size = end - start
        bad = np.flatnonzero((self.cp_off[1:] - self.cp_off[:-1])[v] != size)
        same = same_spans(cp, start, self.cp, self.cp_off[:-1][v], np.where(np.isin(np.arange(len(v)), bad), 0, size) if len(bad) else size)
        bad = np.union1d(bad, np.flatnonzero(~same))
        first = np.searchsorted(start, off)
        lens = (self.off[1:] - self.off[:-1])[v]
        from_ids, at = self.ids, self.off[:-1][v]
        if len(bad):                           # same hash, another pre-token
            joined = "".join(texts)
            own, flat = self.encode([joined[a:b] for a, b in zip(start[bad].tolist(), end[bad].tolist())])
            used = int(self.off[-1])
            lens[bad] = own
            at[bad] = used + np.cumsum(own) - own
            from_ids = np.concatenate([self.ids[:used], np.asarray(flat, np.int32)])
        cum = np.zeros(len(v) + 1, dtype=np.int64)
        np.cumsum(lens, out=cum[1:])
        return from_ids[spread(at, lens)], cum[first]
