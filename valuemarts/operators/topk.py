"""The first rows by a hash of their key, at scale.

``ORDER BY md5(key) LIMIT k`` as Spark plans it lets every task send its own k
first rows to one task.  Here a histogram of the hash's first bits gives a
threshold below which k rows lie, so only about k rows leave all tasks together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BITS = 52                # of the hash, as a number
_BINS = 256


def hash_prefix(key: str):
    """The first 52 bits of the key's md5."""
    return F.conv(F.substring(F.md5(F.col(key)), 1, _BITS // 4), 16, 10).cast("long")


def hash_threshold(df: DataFrame, key: str, size: int) -> int | None:
    """A bound of :func:`hash_prefix` below which ``size`` rows lie, and at most
    a bin more (1/128 of ``size`` as a rule); None if all rows are needed."""
    rows = df.count()
    if rows <= 2 * size:
        return None
    top = 1 << _BITS
    limit = min(top, int(top * 2 * size / rows) + 1)          # holds about 2 * size rows
    while True:
        width = -(-limit // _BINS)
        bins = (df.select(hash_prefix(key).alias("h")).where(F.col("h") < limit)
                .groupBy(F.expr(f"h div {width}").alias("b")).count().collect())     # 256 rows at most
        total = 0
        for b, n in sorted(tuple(r) for r in bins):
            total += n
            if total >= size:
                return min((b + 1) * width, limit)
        if limit == top:
            return None
        limit = min(top, 2 * limit)


def first_by_hash(df: DataFrame, key: str, size: int) -> DataFrame:
    """The ``size`` first rows by (md5(key), key), in that order."""
    bound = hash_threshold(df, key, size)
    some = df if bound is None else df.where(hash_prefix(key) < bound)
    return some.orderBy(F.md5(F.col(key)), F.col(key)).limit(size)
