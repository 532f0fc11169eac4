"""Operator 7: near-duplicate documents by MinHash with odd sketches.

A document's set holds its distinct ``shingle``-word shingles (64-bit
hashes).  One pass over the texts gives each row its set size, a 128-bit hash
of the set, ``bands`` band keys of ``rows`` MinHash values each, and an odd
sketch: ``samples`` MinHash values folded into a parity bitmap.  The
population count of the XOR of two such bitmaps estimates how many samples
differ, hence the similarity, and is most precise where that is high.

Rows of equal sets form a class; only class representatives (the smallest id)
are compared.  Candidates share a band key.  In a bucket every member is
first compared with one hub, so a bucket gives as many pairs as members;
candidates whose odd sketches put them clearly below the threshold
(``slack``, about six standard errors of the samples) are dropped, the others are confirmed
on the full sets, and confirmed links merge into components.  Buckets that
still hold several components are tried again with other hubs while their
open pairs outnumber ``open_pairs`` times the documents; then the members
outside a bucket's largest component are held against all its members of
other components.  In buckets of at most ``SMALL`` members a join does so by
their sketches: first the pairs that the sketches call similar are confirmed
and merged, then each pair still open that may reach the threshold.  Larger
buckets are cut into blocks, and a task compares the full sets of two blocks,
passing on only links between what was not connected yet: as many rows as
members in them at most.  So every pair that shares a bucket is either
connected or compared, without emitting all pairs of a group.

Similarity: 100 * |intersection| >= threshold * |union|, threshold in
percent.  With 16 bands of 3 rows a pair of similarity 0.8 shares no bucket
with probability 1e-5, one of 0.85 with 6e-7.

Edge cases: texts without words (null, empty, blank) have an empty set and
are linked with nothing; a text with fewer words than ``shingle`` has its
whole word sequence as its one shingle; rows that share an id are one
document with several texts (all their links count); a row with a null id
links with nothing and is kept, with a null component; other columns take no
part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuemarts.llm.common import U64, Scratch, arrow_map, ascii_words, chunks, flat_utf8, mix64, span_hash, spread
from valuemarts.llm.graph import components

SKETCH_BITS = 1024
MOST_BROADCAST_PAIRS = 1_000_000
#: members of a bucket whose pairs a join may emit
SMALL = 8
#: members and shingles of a block of a larger bucket
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20
_M = U64(0x9FB21C651E98DF25)


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ascending within each text; offsets)."""
    low, start, end, first = ascii_words(raw, off)
    w = span_hash(low, start, end)
    n = np.diff(first)
    h = w.copy()
    for j in range(1, min(k, len(w))):
        h[:len(w) - j] = mix64(h[:len(w) - j] * _M + w[j:])
    count = np.maximum(n - k + 1, 0)
    short = np.flatnonzero((n > 0) & (n < k))
    whole: dict[int, int] = {}
    for i in short.tolist():
        a, b = first[i], first[i + 1]
        whole[i] = int(mix64(np.bitwise_xor.reduce(w[a:b] * (np.arange(1, b - a + 1, dtype=U64) * U64(2) + U64(1)) + U64(b - a), keepdims=True))[0])
    sets, sizes = [], np.zeros(len(n), dtype=np.int64)
    for i, (a, c) in enumerate(zip(first[:-1].tolist(), count.tolist())):
        if c:
            u = np.sort(h[a:a + c])
            if c > 1:
                u = u[np.append(True, u[1:] != u[:-1])]
        elif i in whole:
            u = np.array([whole[i]], dtype=U64)
        else:
            continue
        sizes[i] = len(u)
        sets.append(u)
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(sizes)])


def _parameters(k: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix64(np.arange(1, 2 * k + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))
    return (seed[:k] >> U64(32)).astype(np.uint32), (seed[k:] >> U64(32)).astype(np.uint32) | np.uint32(1)


def sketches(sets: np.ndarray, off: np.ndarray, bands: int, rows: int, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketch as 64-bit words) of non-empty sets."""
    n, k = len(off) - 1, max(samples, bands * rows)
    mins = np.empty((n, k), dtype=np.uint32)
    x = (sets >> U64(32)).astype(np.uint32)
    xor, mul = _parameters(k)
    for i, j in chunks(off, 1 << 15):
        part, head = x[off[i]:off[j]], off[i:j] - off[i]
        for a in range(0, k, 16):
            mins[i:j, a:a + 16] = np.minimum.reduceat((part[:, None] ^ xor[None, a:a + 16]) * mul[None, a:a + 16], head, axis=0)
    keys = np.empty((n, bands), dtype=U64)
    for b in range(bands):
        h = np.full(n, b + 1, dtype=U64)
        for r in range(rows):
            h = mix64(h * _M + mins[:, b * rows + r])
        keys[:, b] = h
    bit = (mix64(mins.astype(U64) * _M + np.arange(k, dtype=U64)[None, :]) >> U64(64 - (SKETCH_BITS - 1).bit_length())).astype(np.int64)
    at = (np.arange(n)[:, None] * SKETCH_BITS + bit).reshape(-1)
    odd = (np.bincount(at, minlength=n * SKETCH_BITS) & 1).astype(np.uint8).reshape(n, SKETCH_BITS)
    return keys.view(np.int64), np.packbits(odd, axis=1).view(np.int64)


def _lists(a: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    size = np.zeros(n + 1, dtype=np.int32)
    size[1:][rows] = a.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.cumsum(size, dtype=np.int32)), pa.array(a.reshape(-1)))


def signatures(docs: DataFrame, shingle: int = 5, bands: int = 16, rows: int = 3, samples: int = 256, text: str = "text",
               key: str = "doc_id") -> DataFrame:
    """(id, n, a, b, bands, odd): set size, set hash, band keys and odd sketch of each row."""
    src = docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("string"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, off = flat_utf8(batch.column(1))
        total = batch.num_rows
        n, a, b = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int64)
        keys, odd = [np.zeros((0, bands), np.int64)], [np.zeros((0, SKETCH_BITS // 64), np.int64)]
        for i, j in chunks(off):
            sets, cut = shingle_sets(raw[off[i]:off[j]], off[i:j + 1] - off[i], shingle)
            size = np.diff(cut)
            n[i:j] = size
            full = np.flatnonzero(size)
            if len(full):
                head = cut[:-1][full]
                a[i + full] = np.add.reduceat(mix64(sets), head).view(np.int64)
                b[i + full] = np.add.reduceat(mix64(sets ^ _M), head).view(np.int64)
                k, o = sketches(sets, np.append(head, len(sets)), bands, rows, samples)
                keys.append(k)
                odd.append(o)
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n), pa.array(a), pa.array(b), _lists(np.concatenate(keys), some, total),
             _lists(np.concatenate(odd), some, total)], ["id", "n", "a", "b", "bands", "odd"])

    return arrow_map(src, run, "id bigint, n bigint, a bigint, b bigint, bands array<bigint>, odd array<bigint>")


def full_sets(docs: DataFrame, shingle: int, text: str, key: str) -> DataFrame:
    """(id, set): the ascending shingle hashes as bytes."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, off = flat_utf8(batch.column(1))
        out: list[bytes] = []
        for i, j in chunks(off):
            sets, cut = shingle_sets(raw[off[i]:off[j]], off[i:j + 1] - off[i], shingle)
            out += [sets[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "set"])

    return arrow_map(docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("string")), run, "id bigint, set binary")


def _link_blocks(sets: list[np.ndarray], comp: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Pairs (row of ``left``, row of ``right``) whose sets reach the threshold,
    one for each two components that they connect."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    root = np.unique(comp, return_inverse=True)[1].reshape(-1)
    held = np.concatenate([sets[i] for i in right.tolist()])
    owner = np.repeat(np.arange(len(right)), size[right])
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    out: list[tuple[int, int]] = []
    for x in left.tolist():
        if (root[right] == root[x]).all():
            continue
        first, end = np.searchsorted(held, sets[x]), np.searchsorted(held, sets[x], side="right")
        common = np.bincount(owner[spread(first, end - first)], minlength=len(right))
        union = size[x] + size[right] - common
        for y in right[(100 * common >= threshold * union) & (common > 0) & (root[right] != root[x])].tolist():
            if root[y] != root[x]:
                out.append((x, y))
                root[root == root[y]] = root[x]
    return out


def _sets_of(ids: DataFrame, n: int, docs: DataFrame, shingle: int, text: str, key: str) -> DataFrame:
    """:func:`full_sets` of the documents in ``ids`` (__id), ``n`` or fewer;
    a broadcast of them spares the texts a shuffle."""
    if n <= 2 * MOST_BROADCAST_PAIRS:                # beyond it Spark chooses the join
        ids = F.broadcast(ids)
    return full_sets(docs.join(ids, F.col(f"`{key}`") == F.col("__id"), "left_semi"), shingle, text, key)


def _block_links(wide: DataFrame, docs: DataFrame, shingle: int, threshold: int, text: str, key: str, tmp: Scratch, turn: int) -> DataFrame:
    """Links (x, y) between components within each bucket of ``wide`` (bucket,
    rep, n, comp, most), so that every two members whose sets reach the
    threshold end in one component.  A bucket that is larger than a block is
    cut: members outside the largest component are dealt into blocks, those
    inside it into others, and two blocks meet in one task unless both are of
    the largest component.  Buckets of one block share tasks."""
    ids = tmp.write(wide.select(F.col("rep").alias("__id")).distinct(), f"blockids{turn}")
    sets = tmp.write(_sets_of(ids, ids.count(), docs, shingle, text, key), f"blocksets{turn}")
    wide = wide.withColumn("few", F.col("comp") != F.col("most"))

    def blocks(which: Column) -> Column:
        rows, shingles = F.sum(F.when(which, 1).otherwise(0)), F.sum(F.when(which, F.col("n")).otherwise(0))
        return F.greatest(F.lit(1), F.ceil(F.greatest(rows / BLOCK_ROWS, shingles / BLOCK_SHINGLES))).cast("int")

    count = tmp.write(wide.groupBy("bucket").agg(blocks(F.lit(True)).alias("all"), blocks(F.col("few")).alias("nf"), blocks(~F.col("few")).alias("nm"),
                                                 F.sum("n").alias("shingles")), f"blocks{turn}")
    packs = 1 + (count.where("all = 1").agg(F.sum("shingles")).head()[0] or 0) // BLOCK_SHINGLES
    whole, place = F.col("all") == 1, F.xxhash64("rep")
    at = (F.when(whole, 0).when(F.col("few"), F.pmod(place, F.col("nf"))).otherwise(F.col("nf") + F.pmod(place, F.col("nm")))).cast("int")
    last = F.when(whole, 0).when(F.col("few"), F.col("nf") + F.col("nm") - 1).otherwise(F.col("nf") - 1)
    pack = F.when(whole, F.pmod(F.xxhash64("bucket"), F.lit(packs))).otherwise(F.col("bucket"))
    rows = (wide.join(count, "bucket").select("bucket", "rep", "comp", "few", "all", at.alias("at"), F.sequence(F.lit(0), last).alias("meets"), pack.alias("pack"))
            .join(sets.where("length(set) > 0"), F.col("rep") == F.col("id"))
            .select("bucket", "pack", "rep", "comp", "few", "all", "at", "set", F.explode("meets").alias("other"))
            .select("bucket", "pack", F.least("all", F.lit(2)).alias("cut"), F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"),
                    "rep", "comp", "few", "at", "set"))

    def run(t: pa.Table) -> pa.Table:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        rep, comp, at, few = (t[c].to_numpy() for c in ("rep", "comp", "at", "few"))
        sets = [np.frombuffer(x, dtype=U64) for x in t["set"].to_pylist()]
        bucket, found = t["bucket"].to_numpy(), [np.zeros((0, 2), np.int64)]
        order = np.argsort(bucket, kind="stable")
        for here in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            left, right = np.flatnonzero((at[here] == i) & few[here]), np.flatnonzero(at[here] == j)
            if len(left) and len(right):
                pairs = _link_blocks([sets[k] for k in here.tolist()], comp[here], left, right, threshold)
                found.append(here[np.array(pairs, dtype=np.int64).reshape(-1, 2)])
        ends = np.concatenate(found)
        return pa.table({"x": pa.array(rep[ends[:, 0]], pa.int64()), "y": pa.array(rep[ends[:, 1]], pa.int64())})

    return rows.groupBy("pack", "cut", "i", "j").applyInArrow(run, "x bigint, y bigint")


def similar(pairs: DataFrame, docs: DataFrame, shingle: int, threshold: int, text: str, key: str, tmp: Scratch, turn: int) -> DataFrame:
    """The pairs (x, y) whose full sets reach the threshold."""
    ids = pairs.select(F.explode(F.array("x", "y")).alias("__id")).distinct()
    sets = tmp.write(_sets_of(ids, 2 * pairs.count(), docs, shingle, text, key), f"sets{turn}")
    both = (pairs.join(sets.select(F.col("id").alias("x"), F.col("set").alias("sx")), "x")
            .join(sets.select(F.col("id").alias("y"), F.col("set").alias("sy")), "y").select("x", "y", "sx", "sy"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            u, v = np.frombuffer(p, dtype=U64), np.frombuffer(q, dtype=U64)
            if min(len(u), len(v)) * 100 < threshold * max(len(u), len(v)) or not len(u):
                ok.append(False)
                continue
            if len(u) > len(v):
                u, v = v, u
            common = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
            ok.append(100 * common >= threshold * (len(u) + len(v) - common))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["x", "y"]).filter(pa.array(ok, pa.bool_()))

    return arrow_map(both, run, "x bigint, y bigint")


def _close(nx: str, ny: str, ox: str, oy: str, samples: int, threshold: int, slack: float) -> Column:
    """Sizes allow the threshold and the odd sketches don't rule it out."""
    differ = 2 * samples * (1 - threshold / 100 + slack)
    most = SKETCH_BITS / 2 * (1 - np.exp(-2 * differ / SKETCH_BITS))
    z = sum((F.bit_count(F.col(ox)[i].bitwiseXOR(F.col(oy)[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * threshold) & (z <= float(most))


def groups(docs: DataFrame, shingle: int = 5, threshold: int = 80, bands: int = 16, rows: int = 3, samples: int = 256,
           slack: float = 0.15, open_pairs: int = 2000, max_rounds: int = 24, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document row: id, n_shingles, component_id, kept."""
    spark, samples = docs.sparkSession, max(samples, bands * rows)
    with Scratch(spark, "near-dup") as tmp:
        sig = tmp.write(signatures(docs, shingle, bands, rows, samples, text, key), "signatures")
        linked = sig.where("n > 0 and id is not null")
        reps = tmp.write(linked.groupBy("a", "b", "n").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"),
                                                           F.first("odd").alias("odd")), "classes")
        links, tested, comp, n_reps = _versions(linked, reps), None, None, reps.count()
        member = reps.select("rep", "n", F.explode("bands").alias("bucket"))
        shared = member.groupBy("bucket").agg(F.count("*").alias("c"), F.min("rep").alias("hub")).where("c > 1")
        member = tmp.write(member.join(shared, "bucket"), "buckets")

        def looks(side: str, *more: str) -> DataFrame:
            return reps.select(F.col("rep").alias(side), F.col("n").alias(f"n{side}"), F.col("odd").alias(f"o{side}"), *[F.col(m).alias(f"{m}{side}") for m in more])

        def close(slack: float) -> Column:
            return _close("nx", "ny", "ox", "oy", samples, threshold, slack)

        sure = False                                   # the likely links among the open pairs are done, and large buckets
        for turn in range(max_rounds + 3):
            last = every_pair = False
            direct = None
            if turn == 0:
                stars = member.where("rep <> hub")
            else:
                known = comp.select(F.col("node").alias("rep"), F.col("component"))
                live = (member.where(F.col("c").between(3, SMALL) if sure else F.col("c") > 2).join(known, "rep", "left")
                        .select("bucket", "rep", "n", F.col("c").alias("size"), F.coalesce("component", "rep").alias("comp")))
                # open pairs of a bucket: its pairs without those inside one component
                mixed = (live.groupBy("bucket", "comp").agg(F.count("*").alias("c")).groupBy("bucket")
                         .agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("open"), F.max_by("comp", "c").alias("most"))
                         .where("open > 0"))
                live = tmp.write(live.join(mixed, "bucket"), f"open{turn}")
                left = live.groupBy("bucket").agg(F.first("open").alias("open")).agg(F.sum("open")).head()[0]
                if not left:
                    break
                every_pair = sure or turn > max_rounds or left <= open_pairs * n_reps
                last = sure or left <= n_reps
                if not every_pair:
                    hub = live.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)), "rep", "comp")).alias("h"))
                    stars = live.join(hub, "bucket").where("comp <> h.comp").select("rep", F.col("h.rep").alias("hub"))
            if every_pair:
                if not sure:
                    wide = live.where(F.col("size") > SMALL)
                    if wide.head(1):
                        direct = _block_links(wide, docs, shingle, threshold, text, key, tmp, turn)
                    live = live.where(F.col("size") <= SMALL)
                # the pairs that the sketches call similar first: most merge, and few are left for the rest
                sure = True
                few = live.where("comp <> most").select("bucket", F.col("rep").alias("x"), "comp").join(looks("x", "bands"), "x")
                every = live.select(F.col("bucket").alias("__b"), F.col("rep").alias("y"), F.col("comp").alias("cy")).join(looks("y", "bands"), "y")
                # a pair is taken in the first bucket that it shares
                pairs = few.join(every, (F.col("bucket") == F.col("__b")) & (F.col("comp") != F.col("cy")) & close(slack if last else 0.02)
                                 & (F.array_intersect("bandsx", "bandsy")[0] == F.col("bucket")))
                pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
            else:
                pairs = stars.select(F.least("rep", "hub").alias("x"), F.greatest("rep", "hub").alias("y")).distinct()
                pairs = pairs.join(looks("x"), "x").join(looks("y"), "y").where(close(slack)).select("x", "y").distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["x", "y"], "left_anti")
            pairs = tmp.write(pairs, f"pairs{turn}")
            tested = pairs if tested is None else tested.union(pairs)
            links = links.union(similar(pairs, docs, shingle, threshold, text, key, tmp, turn))
            links = tmp.write(links if direct is None else links.union(direct), f"links{turn}")
            comp = tmp.write(components(links, tmp), f"components{turn}")
            if last:
                break
        out = (sig.select("id", "n", "a", "b").join(reps.select("a", "b", "n", "rep"), ["a", "b", "n"], "left")
               .join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
               .select("id", F.col("n").alias("n_shingles"),
                       F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id")))
        out = out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
        return tmp.write(out, "groups", keep=True)


def _versions(linked: DataFrame, reps: DataFrame) -> DataFrame:
    """(x, y): an id with several texts ties their classes together."""
    several = (linked.groupBy("id").agg(F.min("a").alias("p"), F.max("a").alias("q"), F.min("b").alias("r"), F.max("b").alias("s"))
               .where("p <> q or r <> s").select("id"))
    if not several.head(1):
        return linked.sparkSession.createDataFrame([], "x bigint, y bigint")
    return (linked.select("id", "a", "b", "n").join(several, "id", "left_semi").join(reps.select("a", "b", "n", "rep"), ["a", "b", "n"])
            .select(F.col("id").alias("x"), F.col("rep").alias("y")))
