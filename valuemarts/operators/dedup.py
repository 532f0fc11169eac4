"""Keep-first de-duplication on a primary key (the loader's DQ-1 rule).

The reference keeps the first row of each key in file order.  Keys that repeat
are found first, by a hash aggregate over the key columns alone, and only their
rows are touched: rows whose key occurs once pass without being shuffled or
sorted.  Where the repeated keys are few, which AQE sees from their measured
size, they are broadcast.

``keep_by_position`` is for rows that carry a unique number in file order: the
aggregate's minimum of it says which row stays.  ``keep_first`` is for rows
without one: the first is the smallest by a declared order (ascending, NULLs
first), then by every remaining column; exact duplicates are interchangeable.
The rows of repeated keys are ranked, at most one per key and task leaving the
task (Spark pushes the rank limit below the shuffle), so a key that holds a
third of the table is no hot partition.  NULL keys count as equal.

``keep_first_dealt`` is for rows that are to be dealt by one of their key
columns anyway, where no value of it is heavy (``skew.is_spread``): each row
moves once, and the kept rows stay dealt so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _repeated(keys: DataFrame, pk: Sequence[str], *more: Column) -> DataFrame:
    """Keys that occur more than once, under other names."""
    return (keys.groupBy(*pk).agg(F.count(F.lit(1)).alias("_n"), *more).where("_n > 1").drop("_n")
            .withColumnsRenamed({c: f"_key_{c}" for c in pk}))


def _same_key(pk: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in pk:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    return cond


def keep_by_position(df: DataFrame, pk: Sequence[str], position: str, keys: DataFrame | None = None) -> DataFrame:
    """The row of each key with the smallest ``position``, a number that no two
    rows share.  ``keys``: another frame of the same rows to count the keys on."""
    first = _repeated((df if keys is None else keys).select(*pk, position), pk, F.min(position).alias("_first"))
    return df.join(first, _same_key(pk), "left").where(F.col("_first").isNull() | (F.col(position) == F.col("_first"))).select(*df.columns)


def keep_first_dealt(df: DataFrame, pk: Sequence[str], order_by: Sequence[str], column: str, count: int,
                     value: Column | None = None) -> DataFrame:
    """The first row of each key by ``order_by`` (ascending, NULLs first), in
    ``count`` partitions by ``column``, which is one of ``pk``.  With ``value``
    the rows lack that column: they are dealt by its value and get it after."""
    ranked = Window.partitionBy(column, *[c for c in pk if c != column]).orderBy(*[F.col(c).asc_nulls_first() for c in order_by])
    dealt = df.repartition(count, column) if value is None else df.repartition(count, value).withColumn(column, value)
    return dealt.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")


def keep_first(df: DataFrame, pk: Sequence[str], order_by: Sequence[str] | None = None) -> DataFrame:
    pk = list(pk)
    if not pk:
        return df
    cols = df.columns
    order = list(order_by) if order_by is not None else [c for c in cols if c not in pk]
    rest = [c for c in cols if c not in pk and c not in order]
    if not order + rest:
        return df.dropDuplicates(pk)
    repeated = _repeated(df.select(*pk), pk)
    ranked = Window.partitionBy(*pk).orderBy(*[F.col(c).asc_nulls_first() for c in order + rest])
    again = (df.join(repeated, _same_key(pk), "left_semi").withColumn("_rank", F.row_number().over(ranked))
             .where("_rank = 1").select(*cols))
    return df.join(repeated, _same_key(pk), "left_anti").unionByName(again)
