"""Operator 10: secret scans with a linear-chain conditional random field.

Base spans come from three fixed patterns (``BASE``); the span is the whole
match in code points.  A CRF adds spans the patterns miss: it tags tokens as
secret begin (B), inside (I) or outside (O) from hashed features of a token's
shape, its neighbouring words and characters, and its file, and is decoded by
Viterbi.  A begin must be a token of at least 8 characters with a digit and a
letter; an inside must touch the token before it.  So only the neighbourhood
of such tokens (``AROUND`` tokens on both sides, within a line) can hold a
secret, and only these sequences are decoded.

The CRF learns, by gradient ascent on the log likelihood, from sequences of a
bounded sample of documents (about ``max_docs``, chosen by a hash of the
text), tagged by the base spans.  It may add
a span only where the marginal probability of its begin is ``least`` or more.
Added spans never overlap base spans, which all stay.

Edge cases: null and empty texts have no spans; texts of any length count
whole; repeated rows each give a row; with no base span anywhere the CRF adds
nothing; the order of spans is by start, then kind; other columns take no
part.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuemarts.llm.common import arrow_map

#: fixed values: kind, pattern, group whose length counts, least length
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: the same, as conditions that any text with a base span or a candidate meets (RE2)
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
_ACCESS, _HEX = r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}"
_RUN = "[A-Za-z0-9+/_=-]"
_CANDIDATE = "|".join(f"{_RUN}{{{i}}}[0-9]{_RUN}{{{7 - i}}}" for i in range(8))
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")     # a run of at least 24 is a match of the base pattern, and the reverse
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+|[^\sA-Za-z0-9+/_=-]")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
KINDS = ("assign", "access", "hex", "crf")
BITS, AROUND = 16, 5
O, B, I = 0, 1, 2
_NEVER = -1e9
Span = tuple[int, int, int]          # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Base spans in order of start, then kind."""
    out = []
    for k, (name, pattern, group, least) in enumerate(BASE):
        for m in (_LONG_HEX if name == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def _candidate(w: str) -> bool:
    return len(w) >= 8 and any("0" <= c <= "9" for c in w) and any(c.isalpha() for c in w)


def _shape(w: str) -> str:
    s = re.sub(r"[a-f]+", "x", w)
    s = re.sub(r"[g-z]+", "a", s)
    s = re.sub(r"[A-Z]+", "A", s)
    return re.sub(r"[0-9]+", "0", s)


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def features(text: str, tokens: list[tuple[int, int]], i: int, file: tuple[str, ...]) -> list[int]:
    """Hashed features of token i among the tokens of its line."""
    a, b = tokens[i]
    w = text[a:b]
    word = lambda j: text[tokens[j][0]:tokens[j][1]].lower()[:20] if 0 <= j < len(tokens) else "<>"
    shape, n = _shape(w), len(w)
    digits = sum("0" <= c <= "9" for c in w)
    kinds = f"{any(c.islower() for c in w):d}{any(c.isupper() for c in w):d}{digits > 0:d}{any(not c.isalnum() for c in w):d}"
    hexa = all(c in "0123456789abcdef" for c in w)
    own = [f"s:{shape[:8]}", f"n:{min(n, 48) // 4}", f"k:{kinds}", f"h:{hexa:d}{n >= 16:d}", f"d:{5 * digits // n}:{min(n // 8, 4)}",
           f"u:{min(len(set(w)), 20) // 2}", f"r:{min(len(shape), 24) // 3}:{kinds}", f"4:{w[:4] if n >= 8 else w[:8].lower()}"]
    near = [f"-1:{word(i - 1)}", f"+1:{word(i + 1)}", f"-2:{word(i - 2)}|{word(i - 1)}", f"-3:{word(i - 3)}",
            f"c:{text[a - 1:a]}|{text[b:b + 1]}", f"ck:{text[a - 1:a]}|{hexa:d}{min(n // 8, 4)}"]
    return [_hash(x) for x in (*own, *near, *[f"{f}|{kinds}" for f in file])]


def _file(text: str) -> tuple[str, ...]:
    n = max(len(text), 1)
    return (f"f=:{min(text.count('=') * 500 // n, 4)}", f"fl:{min(text.count(chr(10)) * 100 // n, 4)}", f"fb:{'{' in text:d}{'</' in text:d}{'#' in text:d}")


@dataclass
class Sequences:
    """Token windows of one or more texts, end to end."""

    where: list[tuple[int, int, int]]         # text, start, end
    feats: np.ndarray                         # tokens x features
    can: np.ndarray                           # may begin
    touch: np.ndarray                         # touches the token before
    off: np.ndarray                           # sequences


def sequences(texts: list[str], files: list[tuple[str, ...]] | None = None) -> Sequences:
    where, feats, can, touch, off = [], [], [], [], [0]
    for t, text in enumerate(texts):
        lines: dict[int, int] = {}
        for m in _LONG.finditer(text):
            if _candidate(m[0]):
                a = text.rfind("\n", 0, m.start()) + 1
                if a not in lines:
                    b = text.find("\n", m.end())
                    lines[a] = len(text) if b < 0 else b
        if not lines:
            continue
        file = files[t] if files else _file(text)
        for a, b in lines.items():
            tokens = [m.span() for m in _TOKEN.finditer(text, a, b)]
            ok = [_candidate(text[x:y]) for x, y in tokens]
            near = np.zeros(len(tokens) + 1, dtype=bool)
            for i in np.flatnonzero(ok).tolist():
                near[max(i - AROUND, 0):i + AROUND + 1] = True
            near[-1] = False
            inside = False
            for i in range(len(tokens) + 1):
                if near[i]:
                    x, y = tokens[i]
                    where.append((t, x, y))
                    feats.append(features(text, tokens, i, file))
                    can.append(ok[i])
                    touch.append(inside and tokens[i - 1][1] == x)
                elif inside:
                    off.append(len(where))
                inside = bool(near[i])
    return Sequences(where, np.array(feats, dtype=np.int64).reshape(len(where), len(feats[0]) if feats else 1), np.array(can, dtype=bool), np.array(touch, dtype=bool), np.array(off))


@dataclass
class Crf:
    weights: np.ndarray          # buckets x states
    moves: np.ndarray            # state before x state
    least: float = 0.5

    def scores(self, s: Sequences) -> tuple[np.ndarray, np.ndarray]:
        """(emissions, moves into each token), with forbidden ones at -inf."""
        e = self.weights[s.feats].sum(axis=1) if len(s.where) else np.zeros((0, 3))
        e[~s.can, B] = _NEVER
        e[~s.touch, I] = _NEVER
        m = self.moves.copy()
        m[O, I] = _NEVER
        return e, m

    def _padded(self, s: Sequences):
        """Groups of sequences of like length: (index of each token or -1)."""
        n = np.diff(s.off)
        order = np.argsort(n, kind="stable")
        for a in range(0, len(order), 512):
            g = order[a:a + 512]
            at = s.off[g][:, None] + np.arange(int(n[g].max()))[None, :]
            yield np.where(np.arange(at.shape[1])[None, :] < n[g][:, None], at, -1)

    def marginals(self, s: Sequences) -> tuple[np.ndarray, np.ndarray, float]:
        """(state probabilities, expected moves, log normaliser in all)."""
        e, m = self.scores(s)
        p, moves, total = np.zeros_like(e), np.zeros((3, 3)), 0.0
        for at in self._padded(s):
            live, x = at >= 0, e[at]
            k, n = at.shape
            f = np.empty((k, n, 3))
            b = np.zeros((k, n, 3))
            f[:, 0] = x[:, 0]
            for i in range(1, n):
                step = _lse(f[:, i - 1, :, None] + m[None], 1) + x[:, i]
                f[:, i] = np.where(live[:, i, None], step, f[:, i - 1])
            z = _lse(f[:, -1], 1)
            for i in range(n - 2, -1, -1):
                step = _lse(m[None] + (x[:, i + 1] + b[:, i + 1])[:, None, :], 2)
                b[:, i] = np.where(live[:, i + 1, None], step, 0)
            total += z.sum()
            p[at[live]] = np.exp(f + b - z[:, None, None])[live]
            for i in range(1, n):
                on = live[:, i]
                moves += np.exp(f[on, i - 1, :, None] + m[None] + (x[on, i] + b[on, i])[:, None, :] - z[on, None, None]).sum(axis=0)
        return p, moves, total

    def viterbi(self, s: Sequences) -> np.ndarray:
        """The best states of each token."""
        e, m = self.scores(s)
        out = np.zeros(len(e), dtype=np.int64)
        for at in self._padded(s):
            live, x = at >= 0, e[at]
            k, n = at.shape
            best, back = x[:, 0], np.zeros((k, n, 3), dtype=np.int64)
            for i in range(1, n):
                step = best[:, :, None] + m[None]
                back[:, i] = np.where(live[:, i, None], step.argmax(axis=1), np.arange(3)[None])
                best = np.where(live[:, i, None], step.max(axis=1) + x[:, i], best)
            state = best.argmax(axis=1)
            for i in range(n - 1, -1, -1):
                out[at[live[:, i], i]] = state[live[:, i]]
                state = back[np.arange(k), i, state]
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Secret spans of each text by the Viterbi path."""
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        s = sequences(texts)
        if not len(s.where):
            return found
        states, p = self.viterbi(s), self.marginals(s)[0]
        sure = False
        for (t, a, b), state, prob in zip(s.where, states.tolist(), p[:, B].tolist()):
            if state == B:
                sure = prob >= self.least
                if sure:
                    found[t].append((a, b))
            elif state == I and sure:
                found[t][-1] = (found[t][-1][0], b)
            elif state == O:
                sure = False
        return found


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def states_of(s: Sequences, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """States that the spans give: tokens inside one, begun by a token that may begin."""
    y, open_ = np.zeros(len(s.where), dtype=np.int64), -1
    for i, (t, a, b) in enumerate(s.where):
        k = next((j for j, (x, z) in enumerate(spans[t]) if x <= a and b <= z), -1)
        if k >= 0 and s.touch[i] and y[i - 1] != O and open_ == k:
            y[i] = I
        elif k >= 0 and s.can[i]:
            y[i], open_ = B, k
    return y


def train(texts: list[str], spans: list[list[tuple[int, int]]], files: list[tuple[str, ...]] | None = None, rounds: int = 40,
          rate: float = 0.3, decay: float = 1e-4) -> Crf:
    """Gradient ascent (AdaGrad) on the penalised log likelihood."""
    crf = Crf(np.zeros((1 << BITS, 3)), np.zeros((3, 3)))
    s = sequences(texts, files)
    y = states_of(s, spans)
    if not (y == B).any():
        crf.weights[:, B] = _NEVER
        return crf
    inner = np.ones(len(y), dtype=bool)
    inner[s.off[:-1]] = False
    seen = np.zeros((3, 3))
    np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    g2, m2 = np.full_like(crf.weights, 1e-6), np.full((3, 3), 1e-6)
    cols = s.feats.ravel()
    for _ in range(rounds):
        p, moves, _ = crf.marginals(s)
        diff = (np.eye(3)[y] - p) / len(y)
        for k in range(3):
            g = np.bincount(cols, weights=np.repeat(diff[:, k], s.feats.shape[1]), minlength=1 << BITS) - decay * crf.weights[:, k] / len(y)
            g2[:, k] += g * g
            crf.weights[:, k] += rate * g / np.sqrt(g2[:, k])
        g = (seen - moves) / len(y)
        m2 += g * g
        crf.moves += rate * g / np.sqrt(m2)
    return crf


def fit(docs: DataFrame, text: str = "text", max_docs: int = 20000, max_line: int = 20000) -> Crf:
    """Learn from a bounded sample of documents tagged by their base spans:
    their lines of at most ``max_line`` characters that hold a candidate."""
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("t")).where("t is not null")
    scale, n = 1 << 30, max(rows.count(), 1)
    picked = rows.where(F.pmod(F.xxhash64("t"), F.lit(scale)) < int(min(1.0, max_docs / n) * scale))

    def lines(b: pa.RecordBatch) -> pa.RecordBatch:
        # only lines with candidates, and what the file gives: no whole text reaches the driver
        out = []
        for t in b.column(0).filter(pc.match_substring_regex(b.column(0), _CANDIDATE)).to_pylist():
            file, spans = "\t".join(_file(t)), [(a, z) for a, _, z in base_spans(t)]
            for m in re.finditer(r"[^\n]+", t):
                if len(m[0]) <= max_line and any(_candidate(x[0]) for x in _LONG.finditer(m[0])):
                    inside = [f"{a - m.start()}:{z - m.start()}" for a, z in spans if m.start() <= a < m.end()]
                    out.append((m[0], file, " ".join(inside)))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], ["line", "file", "spans"])

    got = arrow_map(picked, lines, "line string, file string, spans string").distinct().toPandas().sort_values(["line", "file", "spans"])
    spans = [[tuple(map(int, x.split(":"))) for x in s.split()] for s in got["spans"]]
    return train(got["line"].tolist(), spans, [tuple(f.split("\t")) for f in got["file"]])


def scan(docs: DataFrame, crf: Crf, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with n_assign, n_access, n_hex, base_sha256 and spans."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)        # a table of fixed size
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    empty = hashlib.sha256(b"").hexdigest()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        col = b.column(len(keep)).fill_null("")
        near = pc.match_substring_regex(col, _ASSIGN)
        for p in (_ACCESS, _HEX):
            near = pc.or_(near, pc.match_substring_regex(col, p))
        near, open_ = near.to_numpy(zero_copy_only=False), pc.match_substring_regex(col, _CANDIDATE).to_numpy(zero_copy_only=False)
        n = np.zeros((3, len(col)), dtype=np.int64)
        sha, spans = [empty] * len(col), [""] * len(col)
        todo = np.flatnonzero(near | open_).tolist()
        for a in range(0, len(todo), 256):
            rows = todo[a:a + 256]
            texts = [col[i].as_py() for i in rows]
            for i, t, more in zip(rows, texts, shared.value.spans(texts)):
                base = base_spans(t) if near[i] else []
                for _, k, _ in base:
                    n[k, i] += 1
                name = lambda xs: ",".join(f"{KINDS[k]}:{x}:{y}" for x, k, y in xs)
                sha[i] = hashlib.sha256(name(base).encode()).hexdigest()
                new = [(x, 3, y) for x, y in more if not any(x < z and s < y for s, _, z in base)]
                spans[i] = name(sorted(base + new))
        return pa.RecordBatch.from_arrays([*b.columns[:len(keep)], *map(pa.array, n), pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                                          [*keep, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return arrow_map(src, run, f"{types + ', ' if types else ''}n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
