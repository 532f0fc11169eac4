"""Joins of a large table with a dimension on a key that may be hot.

A key that holds a third of the rows sends them to one task of a shuffle join.
The heavy keys are found by a frequent-items sketch (``approx_top_k``: counters
in the manner of Misra and Gries, merged as an aggregate is; it misses no key
whose share is above its error), and the join is split: rows of heavy keys meet
their dimension rows by a broadcast, which holds one row per heavy key, and the
others meet by whatever join Spark chooses.  Rows stay where they were read, so
a heavy key is as spread over the tasks as its rows are over the files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a key is heavy from this share of the rows; so at most 128 keys are
HEAVY_SHARE = 1 / 128
#: keys that the sketch counts (a power of two); its error is below 1/1000 of the rows
TRACKED = 8192


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> list[str]:
    """Keys that hold ``share`` of the rows or more, by their sketched counts
    (one pass over the key column, one small row per task)."""
    most = int(1 / share)
    got = (df.where(F.col(key).isNotNull())
           .agg(F.expr(f"approx_top_k({key}, {most}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first())
    return sorted(x["item"] for x in got["top"] or [] if x["count"] >= share * got["n"] and x["count"] > 1)


def is_spread(df: DataFrame, key: str) -> bool:
    """No value of ``key``, nor NULL, holds ``HEAVY_SHARE`` of the rows."""
    return not heavy_keys(df.select(F.coalesce(F.col(key).cast("string"), F.lit("\0")).alias("k")), "k")


def is_unique(dimension: DataFrame, key: str) -> bool:
    """No value of ``key`` but NULL occurs twice (an aggregate of the dimension)."""
    return dimension.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def join_dimension(df: DataFrame, dimension: DataFrame, key: str, heavy: Sequence[str], how: str = "left") -> DataFrame:
    """``df`` joined (inner or left) with a dimension whose ``key`` is unique;
    rows of ``heavy`` keys by a broadcast of their dimension rows, at most one
    per key.  The others meet their dimension rows in a hash table, so the
    large side is not sorted (a sort of it would spill as it grows)."""
    if not heavy:
        return df.join(dimension.hint("shuffle_hash"), key, how)
    inside = F.coalesce(F.col(key).isin(list(heavy)), F.lit(False))
    rest = df.where(~inside).join(dimension.where(~inside).hint("shuffle_hash"), key, how)
    hot = df.where(inside).join(F.broadcast(dimension.where(inside)), key, how)
    return rest.unionByName(hot)
