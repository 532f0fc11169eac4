"""Operator 6: approximate nearest neighbours by an inverted multi-index.

Each vector is cut in two halves; each half is quantised by its own codebook
of K centroids (k-means on a sample of at most ``sample`` vectors, chosen by
a hash of the id), so a vector lies in one of K * K cells.  K grows with the
table (about ``per_cell`` vectors a cell, K at most ``most_centroids``).  A
query walks the centroid pairs in order of summed distance with a heap (the
multi-sequence walk) until the cells visited hold a given share of the
vectors; these are ranked by their exact inner product in double precision.
Distance of a half is minus its inner product with the centroid: the walk
then follows the largest estimated inner product.

The share is measured, not set: on the sample, ``trials`` queries are
answered exactly, and the share is the smallest at which the walk finds
``recall`` of their neighbours.  Clustered vectors need a small share; on
vectors without structure no index can do with little.

Every row is indexed; only codebooks and share see the sample.  The driver
holds the codebooks and one count per cell.  The inverted lists are dealt to
parts of about ``part_rows`` vectors by cell, a hot cell split by a hash of
the id; a query goes once to each part that holds cells it visits, with the
list of these.  The queries of a part are dealt to blocks of at most about
``block_rows`` by a hash, and the part is copied to each of its blocks; how
many queries visit a part is estimated from above on a sample of them.  A
block ranks its queries by matrix products over the lists, and returns the
best k of each; the best of those are the result.

Edge cases: a vector that is null, zero, of another length than the valid
vector with the smallest id, or holds a null or non-finite component takes no
part; repeated ids are candidates each, and a query does not find rows of its
own id; ties go to the smaller id; fewer than k candidates in all are all
returned; other columns take no part.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valuemarts.llm.common import Scratch


@dataclass
class MultiIndex:
    """Codebooks of the two halves and the number of vectors in each cell."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray | None = None

    def cells(self, x: np.ndarray) -> np.ndarray:
        half = self.first.shape[1]
        return _nearest(x[:, :half], self.first) * len(self.second) + _nearest(x[:, half:], self.second)

    def walk(self, q: np.ndarray, budget: int) -> list[int]:
        """Cells in order of summed distance until they hold ``budget`` vectors."""
        half = self.first.shape[1]
        a, b = -(self.first @ q[:half]), -(self.second @ q[half:])
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b, k = a[i], b[j], len(b)
        heap, seen, got, out = [(a[0] + b[0], 0, 0)], {(0, 0)}, 0, []
        while heap and got < budget:
            _, x, y = heapq.heappop(heap)
            cell = int(i[x]) * k + int(j[y])
            if self.counts[cell]:
                out.append(cell)
                got += int(self.counts[cell])
            for u, v in ((x + 1, y), (x, y + 1)):
                if u < len(a) and v < k and (u, v) not in seen:
                    seen.add((u, v))
                    heapq.heappush(heap, (a[u] + b[v], u, v))
        return out


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid (Euclidean), for the k-means cells."""
    return ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        full = n > 0
        c[full] = sums[full] / n[full, None]
    return c


def valid(vectors: DataFrame, vector: str, key: str, size: int | None) -> DataFrame:
    """(id, v): the vectors that take part, in double precision."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return rows if size is None else rows.where(F.size("v") == size)


def share_needed(index: MultiIndex, x: np.ndarray, k: int, recall: float, trials: int) -> float:
    """Smallest share of the vectors whose cells, in order of the walk, hold
    ``recall`` of the k nearest neighbours of trial queries."""
    half, cells = index.first.shape[1], index.cells(x)
    counts = np.bincount(cells, minlength=len(index.first) * len(index.second))
    reach = []
    for t in np.linspace(0, len(x) - 1, min(trials, len(x))).astype(int):
        s = x @ x[t]
        s[t] = -np.inf
        near = np.argsort(-s, kind="stable")[:min(k, len(x) - 1)]
        order = np.argsort(-((index.first @ x[t, :half])[:, None] + (index.second @ x[t, half:])[None, :]).ravel(), kind="stable")
        upto = np.empty(len(order))
        upto[order] = np.cumsum(counts[order])
        reach.append(upto[cells[near]])
    got = np.concatenate(reach) if reach else np.zeros(0)
    return float(np.quantile(got, recall) / len(x)) if len(got) else 1.0


def block_counts(visits: np.ndarray, sampled: int, queries: int, block_rows: int) -> np.ndarray:
    """Blocks of each part, from how many of ``sampled`` queries visit it: the
    share is taken three standard errors higher, at most 1."""
    if queries <= block_rows:
        return np.ones(len(visits), dtype=np.int64)
    most = np.minimum((visits + 3 * np.sqrt(visits) + 9) / max(sampled, 1), 1.0) * queries
    return np.maximum(np.ceil(most / block_rows).astype(np.int64), 1)


def search(vectors: DataFrame, queries: Column, k: int = 20, recall: float = 0.95, per_cell: int = 16, most_centroids: int = 256,
           sample: int = 20000, trials: int = 200, part_rows: int = 8192,
           block_rows: int = 8192, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for every row where
    ``queries`` (on the column ``id``) holds."""
    spark = vectors.sparkSession
    first = valid(vectors, vector, key, None).agg(F.min_by(F.size("v"), "id").alias("d"), F.count("*").alias("n")).head()
    if not first["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, n = int(first["d"]), int(first["n"])
    rows = valid(vectors, vector, key, size)
    scale = 1 << 30
    part = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(scale)) < int(min(1.0, sample / n) * scale)).toPandas()
    if not len(part):
        part = rows.orderBy("id").limit(1).toPandas()
    part = part.sort_values("id", kind="stable")
    x = np.array(part["v"].tolist(), dtype=np.float64).reshape(len(part), size)
    half = max(size // 2, 1)
    cells = int(np.clip(np.sqrt(max(n / per_cell, 1)), 1, most_centroids))
    index = MultiIndex(kmeans(x[:, :half], cells, seed=3), kmeans(x[:, half:], cells, seed=4) if size > half else np.zeros((1, 0)))
    share = share_needed(index, x, k, recall, trials)
    books = spark.sparkContext.broadcast(index)             # two codebooks of at most most_centroids rows

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(books.value.cells(np.array(v.tolist(), dtype=np.float64).reshape(len(v), -1)), dtype="int32")

    with Scratch(spark, "ann") as tmp:
        inverted = tmp.write(rows.withColumn("cell", cell_of("v")), "inverted")
        counts = np.zeros(len(index.first) * len(index.second), dtype=np.int64)
        for r in inverted.groupBy("cell").count().collect():     # at most most_centroids ** 2 rows
            counts[r["cell"]] = r["count"]
        total = int(counts.sum())
        parts = max(1, -(-total // part_rows))
        splits = np.maximum(-(-counts * 4 // part_rows), 1)      # pieces of a cell, each a quarter of a part at most
        first_piece = np.concatenate([[0], np.cumsum(splits)])
        budget = int(np.ceil(share * total)) + k + 1
        full = spark.sparkContext.broadcast((MultiIndex(index.first, index.second, counts), splits, first_piece))

        @F.pandas_udf("int")
        def piece_of(cell: pd.Series, h: pd.Series) -> pd.Series:
            _, split, begin = full.value
            c = cell.to_numpy()
            return pd.Series(begin[c] + h.to_numpy() % split[c], dtype="int32")

        kinds, most_sampled = "id long, v array<double>, part int, pieces array<int>", 2000

        def visits(batches):
            idx, split, begin = full.value
            for b in batches:
                out = []
                for i, v in zip(b["id"], b["v"]):
                    got = np.array(idx.walk(np.asarray(v, dtype=np.float64), budget), dtype=np.int64)
                    pieces = np.repeat(begin[got], split[got]) + np.concatenate([np.arange(s) for s in split[got]])
                    for p in np.unique(pieces % parts):
                        out.append((i, v, int(p), pieces[pieces % parts == p]))
                yield pd.DataFrame(out, columns=["id", "v", "part", "pieces"])

        wanted = rows.where(queries)
        asking = wanted.count()
        seen, sampled = np.zeros(parts, dtype=np.int64), 0
        if asking > block_rows:                                  # else one block holds all
            few = wanted.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(scale)) < int(min(1.0, most_sampled / asking) * scale))
            sampled = few.count()
            for r in few.mapInPandas(visits, kinds).groupBy("part").count().collect():      # one row a part
                seen[r["part"]] = r["count"]
        blocks = spark.sparkContext.broadcast(block_counts(seen, sampled, asking, block_rows))

        @F.pandas_udf("int")
        def blocks_of(part: pd.Series) -> pd.Series:
            return pd.Series(blocks.value[part.to_numpy()], dtype="int32")

        asked = wanted.mapInPandas(visits, kinds)
        asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "v", F.lit(11)), blocks_of("part")).cast("int"))
        held = inverted.withColumn("piece", piece_of("cell", F.xxhash64("id").bitwiseAND(F.lit((1 << 62) - 1))))
        held = held.select("id", "v", "piece", F.pmod("piece", F.lit(parts)).alias("part"))

        held = held.withColumn("block", F.explode(F.sequence(F.lit(0), blocks_of("part") - 1)))

        def best(key_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
            if not len(left) or not len(right):
                return found[0]
            right = right.sort_values("id", kind="stable")
            ids, piece = right["id"].to_numpy(), right["piece"].to_numpy()
            names, where = np.unique(piece, return_inverse=True)
            m = np.array(right["v"].tolist(), dtype=np.float64)
            length = np.sqrt((m * m).sum(axis=1)).max()
            for a in range(0, len(left), 256):
                block = left.iloc[a:a + 256]
                own, q = block["id"].to_numpy(), np.array(block["v"].tolist(), dtype=np.float64)
                s = q @ m.T
                for r, visited in enumerate(block["pieces"]):
                    open_ = np.isin(names, visited)[where] & (ids != own[r])
                    s[r, ~open_] = -np.inf
                    few = min(k, int(open_.sum()))
                    if not few:
                        continue
                    # all that may reach the k-th score, then the score itself, computed alike for every pair
                    low = np.partition(s[r], len(ids) - few)[len(ids) - few] - 1e-9 * (1 + length * np.sqrt(q[r] @ q[r]))
                    c = np.flatnonzero(s[r] >= low)
                    exact = (m[c] * q[r]).sum(axis=1)
                    top = np.argsort(-exact, kind="stable")[:k]           # ties: ids ascend
                    found.append(pd.DataFrame({"query_id": np.full(len(top), own[r]), "vec_id": ids[c[top]], "score": exact[top]}))
            return pd.concat(found)

        found = (asked.groupBy("part", "block").cogroup(held.groupBy("part", "block"))
                 .applyInPandas(best, "query_id long, vec_id long, score double"))
        # best k of the parts' best k
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        return tmp.write(out.select("query_id", F.col("rank").cast("int"), "vec_id", "score"), "found", keep=True)
