"""Operator 9: token-id files with canonical length-limited Huffman codes.

``write`` encodes texts with the tokenizers library, appends an end id to
each document, counts all ids, and writes the ids in ascending document order
as blocks; ``read`` gives them back from the files alone.

Format.  A folder holds three Parquet tables.  ``codebook`` (id, bits): the
code length of each id that occurs; codes are canonical, by length and then
id, at most ``max_bits`` long.  ``files`` (file, first): the number of ids of
all documents before a file.  ``blocks``, one row per block: file, block
(position within the file), first (number of ids of the file before the block),
n (its ids), doc_ids, lengths (ids per document, end id included), checks (bit
offset in the payload of every STEP-th id of each document, from its first),
payload.  Each document begins on a byte.  A block holds whole documents, at
least ``block_ids`` ids but for the last of a file, and is decoded on its own;
checkpoints let all its segments be decoded at once.  Files ascend by
document id and are numbered in that order.

Passes: ids are written once (the tokenizer runs once) and counted by the same
tasks (the counts' sums are at most one row per id on the driver), coded, then
dealt to files by cut keys.  The cut keys are quantiles, by ids, of a sample of
rows' keys (document id, number of ids, hash, row), about ``PER_FILE`` for each
file and ``SAMPLE`` at most, as a range partitioner takes them; so files are
even in ids also where documents are long, where most rows share an id or have
none, and where rows repeat.  A file has about ``file_ids`` ids, more where
there would be over ``MOST_FILES``.

The library encodes each distinct pre-token that a worker meets; it encodes a
pre-token alone as it does inside a text.

Edge cases: a null or empty text is just the end id; rows with a null id come
first; rows that share an id follow each other by number of ids, then coded
bytes; the empty table gives empty tables; texts of any length are one
document; other columns take no part.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuemarts.llm.bpe import encode_with, read_tokenizer
from valuemarts.llm.common import Scratch, arrow_map, chunks, strings
from valuemarts.llm.huffman import Decoder, canonical, code_lengths, pack
from valuemarts.llm.pretoken import TokenCache

STEP = 128
#: files at most; keys sampled per file, and in all
MOST_FILES, PER_FILE, SAMPLE = 20_000, 256, 400_000


class LibraryEncoder:
    """Whole texts to ids by the tokenizers library, through a cache of pre-tokens."""

    def __init__(self, content: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t["content"]: t["id"] for t in json.loads(content).get("added_tokens") or ()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache = TokenCache(self._words)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(1 + max(vocab.values(), default=0), dtype=np.int64)      # bytes of each id
        for token, i in vocab.items():
            self.width[i] = len(token)

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([len(x) for x in ids], dtype=np.int64), np.array([i for x in ids for i in x], dtype=np.int32)

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of a blank and letters, which stay pre-tokens of
        their own in a row: many are encoded as one text, and their ids are
        told apart by the bytes that the ids stand for."""
        rows = [words[i:i + 256] for i in range(0, len(words), 256)]
        lens, flat = [], []
        for row, got in zip(rows, self.tokenizer.encode_batch_fast(["".join(r) for r in rows], add_special_tokens=False)):
            ids = np.array(got.ids, dtype=np.int32)
            end = np.cumsum(self.width[ids])
            want = np.cumsum([len(w.encode()) for w in row])
            at = np.searchsorted(end, want)
            if at[-1] != len(end) - 1 or not (end[at] == want).all():
                n, ids = self._alone(row)
            else:
                n = np.diff(at, prepend=-1)
            lens.append(n)
            flat.append(ids)
        return np.concatenate(lens), np.concatenate(flat)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter((w[0] == " " and w[1:].isalpha() for w in words), dtype=bool, count=len(words))
        if not plain.any():
            return self._alone(words)
        lens = np.zeros(len(words), dtype=np.int64)
        own, ids = self._joined([w for w, p in zip(words, plain.tolist()) if p])
        lens[plain] = own
        if plain.all():
            return lens, ids
        other, more = self._alone([w for w, p in zip(words, plain.tolist()) if not p])
        lens[~plain] = other
        flat = np.zeros(int(lens.sum()), dtype=np.int32)
        of = np.repeat(plain, lens)
        flat[of], flat[~of] = ids, more
        return lens, flat

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return encode_with(self.cache, self.special, self.split, texts)


_ENCODERS: dict[bytes, LibraryEncoder] = {}


def encoder_of(content: bytes) -> LibraryEncoder:
    key = hashlib.sha256(content).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = LibraryEncoder(content)
    return _ENCODERS[key]


def _encoded(docs: DataFrame, content, end_id: int, size: int, dtype: str, text: str, key: str) -> DataFrame:
    """(doc_id, n, ids, counts): the ids with the end id, as little-endian bytes;
    and a last row of each task, without ids, that counts the task's ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            flat, off = encoder_of(content.value).encode(strings(b.column(1)))
            flat = np.insert(flat, off[1:], end_id).astype(dtype)
            total += np.bincount(flat, minlength=size)
            off = off + np.arange(len(off))
            w = flat.dtype.itemsize
            data = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((off * w).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), data, pa.nulls(b.num_rows, pa.binary())], ["doc_id", "n", "ids", "counts"])
        some = np.flatnonzero(total)
        if len(some):
            counts = np.stack([some, total[some]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts], pa.binary())],
                                             ["doc_id", "n", "ids", "counts"])

    src = docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("string"))
    return src.mapInArrow(run, "doc_id bigint, n bigint, ids binary, counts binary")


def _ids_of(col: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of a column of id bytes."""
    parts = col.to_pylist()
    w = np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(parts), dtype=dtype).astype(np.int32), np.concatenate([[0], np.cumsum([len(x) // w for x in parts])]).astype(np.int64)


def counts_of(encoded: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all documents, from the tasks' counts."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [np.frombuffer(x, "<i8").reshape(2, -1) for x in b.column(0).to_pylist()]
        ids, n = np.concatenate(pairs, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(n)], ["id", "c"])

    out = np.zeros(size, dtype=np.int64)
    rows = arrow_map(encoded.where("counts is not null").select("counts"), run, "id int, c bigint")
    for r in rows.groupBy("id").agg(F.sum("c").alias("c")).collect():          # one row per id of the vocabulary
        out[r["id"]] = r["c"]
    return out


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, max_bits: int = 18, block_ids: int = 1 << 16,
          file_ids: int = 1 << 23, text: str = "text", key: str = "doc_id") -> None:
    """Encode ``docs`` and write the folder ``path`` in the module's format."""
    spark = docs.sparkSession
    raw = read_tokenizer(tokenizer_path)
    spec = json.loads(raw)
    size = 1 + max(end_id, *spec["model"]["vocab"].values(), *[t["id"] for t in spec.get("added_tokens") or ()])
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    content = spark.sparkContext.broadcast(raw)
    with Scratch(spark, "token-file") as tmp:
        encoded = _encoded(docs, content, end_id, size, dtype, text, key)
        encoded = tmp.write(encoded.withColumns({"h": F.xxhash64("ids"), "r": F.xxhash64(F.monotonically_increasing_id())}), "ids", codec="zstd")
        counts = counts_of(encoded, size)
        ids = encoded.where("counts is null").select("doc_id", "n", "ids", "h", "r")
        lengths = code_lengths(counts, max(max_bits, int(np.ceil(np.log2(max(np.count_nonzero(counts), 2))))))
        used = np.flatnonzero(lengths)
        spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
        files = min(MOST_FILES, int(max(1, -(-int(counts.sum()) // file_ids))))
        shared = spark.sparkContext.broadcast((canonical(lengths), lengths, _cuts(ids, files)))

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            codes, sizes, at = shared.value
            flat, off = _ids_of(b.column(2), dtype)
            data, checks = [], []
            for i, j in chunks(off):                 # bounded working memory
                d, c = pack(flat[off[i]:off[j]], off[i:j + 1] - off[i], codes, sizes, STEP)
                data += d
                checks += c
            file = _below(at, _sort_keys(b.column(0), b.column(1), b.column(3), b.column(4)))
            lens = np.concatenate([[0], np.cumsum([len(c) for c in checks])]).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(file.astype(np.int32)), b.column(0), b.column(1), pa.array(data, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(lens), pa.array(np.concatenate(checks).astype(np.int64)))],
                ["file", "doc_id", "n", "bits", "checks"])

        coded = arrow_map(ids, run, "file int, doc_id bigint, n bigint, bits binary, checks array<bigint>")
        dealt = coded.repartition(files, "file").sortWithinPartitions(F.col("file"), F.col("doc_id").asc_nulls_first(), "n", "bits")

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            file, block, first = -1, 0, 0
            docs_, lens, checks, data, held, size_ = [], [], [], [], 0, 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([docs_], pa.list_(pa.int64())),
                     pa.array([lens], pa.list_(pa.int64())), pa.array([np.concatenate(checks)], pa.list_(pa.int64())), pa.array([b"".join(data)], pa.binary())],
                    ["file", "block", "first", "n", "doc_ids", "lengths", "checks", "payload"])

            for b in batches:
                for f, d, n, bits, c in zip(*[x.to_pylist() for x in b.columns]):
                    if f != file or held >= block_ids:
                        if docs_:
                            yield out()
                        first, block = (first + held, block + 1) if f == file else (0, 0)
                        file, docs_, lens, checks, data, held, size_ = f, [], [], [], [], 0, 0
                    docs_.append(d)
                    lens.append(n)
                    checks.append(np.array(c, dtype=np.int64) + 8 * size_)
                    data.append(bits)
                    held, size_ = held + n, size_ + len(bits)
            if docs_:
                yield out()

        dealt.mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")
        sums = {r["file"]: r["n"] for r in spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("file").agg(F.sum("n").alias("n")).collect()}
        order = sorted(sums)                                                     # MOST_FILES at most
        first = np.cumsum([0] + [sums[f] for f in order]).tolist()
        spark.createDataFrame(list(zip(order, first)), "file int, first long").coalesce(1).write.parquet(f"{path}/files")


BLOCKS = "file int, block int, first bigint, n bigint, doc_ids array<bigint>, lengths array<bigint>, checks array<bigint>, payload binary"


def _sort_keys(doc_id: pa.Array, n: pa.Array, h: pa.Array, r: pa.Array) -> np.ndarray:
    """(4, rows): null ids lie below all others."""
    return np.stack([doc_id.fill_null(-(1 << 63)).to_numpy(), n.to_numpy(), h.to_numpy(), r.to_numpy()])


def _below(cuts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many of the ascending cut keys are at or below each key."""
    n = cuts.shape[1]
    both = np.concatenate([cuts, keys], axis=1)
    order = np.lexsort((np.arange(both.shape[1]) >= n, *both[::-1]))          # a cut before its equals
    out = np.empty(both.shape[1], np.int64)
    out[order] = np.cumsum(order < n)
    return out[n:]


def _cuts(ids: DataFrame, files: int) -> np.ndarray:
    """(4, files - 1 or fewer) ascending cut keys that part the ids evenly, from
    a sample of the rows' keys weighted by their numbers of ids."""
    none = np.zeros((4, 0), np.int64)
    if files < 2:
        return none
    every = max(1, ids.count() // min(SAMPLE, PER_FILE * files))
    some = ids.select("doc_id", "n", "h", "r").where(F.pmod("r", F.lit(every)) == 0).toArrow()
    if not some.num_rows:
        return none
    keys = _sort_keys(*[c.combine_chunks() for c in some.columns])
    keys = keys[:, np.lexsort(keys[::-1])]
    total = np.cumsum(keys[1])
    at = np.searchsorted(total, total[-1] * np.arange(1, files) / files)
    return keys[:, np.unique(np.minimum(at, keys.shape[1] - 1))]


def _decoded(spark: SparkSession, path: str, fn, schema: str) -> DataFrame:
    """``fn(doc_ids, first, lengths, ids)`` over groups of blocks."""
    book = spark.read.schema("id int, bits int").parquet(f"{path}/codebook").collect()       # one row per id of the vocabulary
    lengths = np.zeros(1 + max([r["id"] for r in book], default=0), dtype=np.uint8)
    for r in book:
        lengths[r["id"]] = r["bits"]
    before = {r["file"]: r["first"] for r in spark.read.schema("file int, first long").parquet(f"{path}/files").collect()}
    shared = spark.sparkContext.broadcast((lengths, before))
    src = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value[0])
        first_of = shared.value[1]
        for b in batches:
            for a in range(0, b.num_rows, 32):
                part = b.slice(a, 32)
                size = np.array([len(x) for x in part.column(3).to_pylist()], dtype=np.int64)
                base = np.concatenate([[0], np.cumsum(size)])
                lens = [np.array(x, dtype=np.int64) for x in part.column(2).to_pylist()]
                n = np.concatenate(lens)
                bit = np.concatenate([np.array(x, dtype=np.int64) + 8 * o for x, o in zip(part.column(4).to_pylist(), base)])
                segs = -(-n // STEP)
                count = np.full(int(segs.sum()), STEP, dtype=np.int64)
                count[np.cumsum(segs) - 1] = n - (segs - 1) * STEP
                ids = decoder.segments(np.frombuffer(b"".join(part.column(3).to_pylist()), dtype=np.uint8), bit, count)
                start = np.concatenate([first_of[f] + p + np.cumsum(x) - x for f, p, x in zip(part.column(5).to_pylist(), part.column(0).to_pylist(), lens)])
                yield fn([d for x in part.column(1).to_pylist() for d in x], start, n, ids)

    return src.select("first", "doc_ids", "lengths", "payload", "checks", "file").mapInArrow(run, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (end id included)."""
    def fn(docs, start, n, ids):
        off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start), pa.ListArray.from_arrays(pa.array(off), pa.array(ids))], ["doc_id", "start", "ids"])
    return _decoded(spark, path, fn, "doc_id bigint, start bigint, ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian
    unsigned 32-bit integers, from the files."""
    def fn(docs, start, n, ids):
        raw, cut = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(n)]) * 4
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
    return _decoded(spark, path, fn, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
