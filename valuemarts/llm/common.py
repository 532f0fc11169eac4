"""Helpers shared by the operators: column hygiene, deterministic splits,
flat UTF-8 views of Arrow text columns, word hashing, scratch tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuemarts.session import checkpoint_dir, delete_path

U64 = np.uint64
#: odd multiplier of the span hash
_R = 0x9E3779B97F4A7C15


def split_of(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id gives null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(parts))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/valuemarts/{name}-{uuid.uuid4().hex}"


#: folders that results still read: (session's application, path)
_KEPT: list[tuple[str, str]] = []


def keep_until_release(spark: SparkSession, path: str) -> str:
    """Note a folder that a result reads; :func:`release` deletes it."""
    _KEPT.append((spark.sparkContext.applicationId, path))
    return path


def release(spark: SparkSession) -> int:
    """Delete the tables that the results handed out so far read, in this
    session's application; such results must not be used afterwards."""
    mine = [x for x in _KEPT if x[0] == spark.sparkContext.applicationId]
    for x in mine:
        delete_path(spark, x[1])
        _KEPT.remove(x)
    return len(mine)


class Scratch:
    """Tables below the shared checkpoint folder, written as Parquet and read
    back: this cuts the lineage and survives lost executors.  Leaving the
    ``with`` block deletes those not marked ``keep``; the others, which the
    caller's result reads, go with :func:`release`."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc: object) -> None:
        for p in self.paths:
            delete_path(self.spark, p)

    def write(self, df: DataFrame, name: str, keep: bool = False, codec: str | None = None) -> DataFrame:
        path = scratch_path(self.spark, f"{self.name}-{name}")
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
        if keep:
            keep_until_release(self.spark, path)
        else:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` over each Arrow batch of ``df``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield fn(b)
    return df.mapInArrow(run, schema)


def strings(col: pa.Array) -> list[str]:
    """Texts of an Arrow column; null is the empty text."""
    return [x or "" for x in col.to_pylist()]


def flat_utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying the text;
    null is the empty text."""
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + n + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def chunks(off: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``size`` bytes each (one row at least)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (size[i] of them), span by span."""
    cum = np.cumsum(size)
    return np.repeat(start - (cum - size), size) + np.arange(int(cum[-1]) if len(cum) else 0)


def same_spans(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[at:at+size) equals b[bt:bt+size), for many spans; bytes are
    compared eight at a time."""
    ok = np.ones(len(size), dtype=bool)
    if not len(size):
        return ok
    step, most = 1, 32
    x, y = a, b
    if a.dtype == np.uint8:
        step, most = 8, 64
        x = np.ndarray((len(a) + 1,), "<u8", buffer=np.concatenate([a, np.zeros(8, np.uint8)]), strides=(1,))
        y = x if b is a else np.ndarray((len(b) + 1,), "<u8", buffer=np.concatenate([b, np.zeros(8, np.uint8)]), strides=(1,))
    live, k = np.flatnonzero(size > 0), 0
    while len(live) and k < most * step:
        p, q = x[at[live] + k], y[bt[live] + k]
        if step == 8:
            keep = _KEEP_BYTES[np.minimum(size[live] - k, 8)]
            p, q = p & keep, q & keep
        ok[live] = p == q
        k += step
        live = live[(size[live] > k) & ok[live]]
    for i in live.tolist():                    # the rest of long spans
        ok[i] = np.array_equal(a[at[i] + k:at[i] + size[i]], b[bt[i] + k:bt[i] + size[i]])
    return ok


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: bytes of a span that go into one 64-bit lane, and code points (21 bits each)
_LANE_BYTES, _LANE_POINTS = 8, 3
_MOST_LANES = 64
_KEEP_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=U64)


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end) for many spans of one flat array.
    ``values`` are bytes or code points.  A span is read in lanes of 64 bits,
    each mixed into the state by a bijection that is not linear, so no texts
    are known that collide by their structure; spans of more than
    ``_MOST_LANES`` lanes get a BLAKE2 digest instead."""
    n = len(start)
    if n == 0:
        return np.zeros(0, U64)
    start, end = np.asarray(start, np.int64), np.asarray(end, np.int64)
    size = end - start
    as_bytes = values.dtype == np.uint8
    width = _LANE_BYTES if as_bytes else _LANE_POINTS
    h = mix64(size.astype(U64) * U64(0xA24BAED4963EE407) + U64(0x2545F4914F6CDD1D))
    long = np.flatnonzero(size > width * _MOST_LANES)
    if as_bytes:
        padded = np.concatenate([values, np.zeros(8, np.uint8)])
        lanes = np.ndarray((len(values) + 1,), "<u8", buffer=padded, strides=(1,))
    else:
        padded = np.concatenate([values, np.zeros(3, values.dtype)]).astype(U64)
    live = np.flatnonzero((size > 0) & (size <= width * _MOST_LANES))
    lane = 0
    while len(live):
        at, left = start[live] + lane * width, size[live] - lane * width
        if as_bytes:
            x = lanes[at] & _KEEP_BYTES[np.minimum(left, 8)]
        else:
            x = padded[at]
            for i in (1, 2):
                x |= np.where(left > i, padded[at + i], U64(0)) << U64(21 * i)
        h[live] = mix64((h[live] ^ x) * U64(_R) + U64(lane + 1))
        lane += 1
        live = live[left > width]
    for i in long.tolist():
        h[i] ^= U64(int.from_bytes(hashlib.blake2b(values[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little"))
    return h


#: lower-cases A-Z only; the separators of ``[^\x20\x09-\x0D]+``
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[[0x20, 9, 10, 11, 12, 13]] = True


def ascii_words(raw: np.ndarray, off: np.ndarray, separators: np.ndarray = _IS_SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` (or those between other ``separators``, a
    mask of ASCII bytes) of texts lower-cased in A-Z: (lowered bytes, word
    start, word end, first word of each text, with an end sentinel).  UTF-8
    multi-byte characters hold no separator bytes."""
    low = _LOWER[raw]
    inside = np.zeros(len(raw) + 2, dtype=bool)
    np.logical_not(separators[raw], out=inside[1:-1])
    begin = inside[1:-1] & ~inside[:-2]
    stop = inside[1:-1] & ~inside[2:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    begin[cut] = inside[1:-1][cut]            # a text's first byte begins a word
    stop[cut - 1] = inside[1:-1][cut - 1]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(stop) + 1
    return low, start, end, np.searchsorted(start, off)
