"""Global ``NTILE(k) OVER (ORDER BY x ASC NULLS LAST, id)`` by cut keys.

``F.ntile(k).over(Window.orderBy(x))`` moves every row into one partition.
But a row's tile only depends on how many of the k - 1 *cut keys* (the keys
``(x IS NULL, x, id)`` at the last position of tiles 1 .. k-1) lie below it.
So the tile is a projection over k - 1 literals per column, with no shuffle
of the rows, once the cut keys are known.  They are found by narrowing:

1. count the rows;
2. for each cut keep a range of keys that holds its position, at first all
   keys.  A pass draws up to ``PROBES`` keys from each range that is still too
   large (a deterministic sample by hash of the id), counts the rows of the
   segments between these keys in one aggregate, and keeps the segment that
   holds the position;
3. when every range holds at most ``rank_rows`` rows, these rows are collected
   in key order and the cut keys read off.

Rows move only in step 3 and in the sample: a bounded number whatever the
input, and the number of passes follows from its size (each pass divides a
range by about ``PROBES``).  Ties on x are split by id, so a value that most
rows share is narrowed like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

PROBES = 64


@dataclass(frozen=True)
class NtileSpec:
    order_col: str
    out_col: str
    k: int = 5


Key = tuple      # (value, id); a NULL value sorts last


def _order(key: Key) -> tuple:
    return (key[0] is None, 0 if key[0] is None else key[0], key[1])


def _above(key: Key, order_col: str, id_col: str) -> Column:
    """The row's key is greater than ``key``."""
    x, i = F.col(order_col), F.col(id_col)
    value, ident = key
    if value is None:
        return x.isNull() & (i > F.lit(ident))
    v = F.lit(value)
    return F.coalesce((x > v) | ((x == v) & (i > F.lit(ident))), F.lit(True))


def cut_positions(n: int, k: int) -> list[int]:
    """Row numbers of the last rows of tiles 1 .. k-1 (0: the tile is empty
    and so are all after it up to the row count)."""
    q, r = divmod(n, k)
    return [t * q + min(t, r) for t in range(1, k)]


@dataclass
class _Range:
    """Rows with low < key <= high (None: open); ``skip`` rows lie below."""

    low: Key | None
    high: Key | None
    skip: int
    rows: int


def _within(r: _Range, order_col: str, id_col: str) -> Column:
    cond = F.lit(True)
    if r.low is not None:
        cond = cond & _above(r.low, order_col, id_col)
    if r.high is not None:
        cond = cond & ~_above(r.high, order_col, id_col)
    return cond


def cut_keys(base: DataFrame, spec: NtileSpec, id_col: str, n: int, rank_rows: int = 4096) -> list[Key]:
    """The keys of the last rows of tiles 1 .. k-1, ascending."""
    o = spec.order_col
    positions = [p for p in dict.fromkeys(cut_positions(n, spec.k)) if 0 < p < n]
    ranges = {p: _Range(None, None, 0, n) for p in positions}
    keys = base.select(F.col(o), F.col(id_col))
    scale = 1 << 30
    turn = 0
    while any(r.rows > rank_rows for r in ranges.values()):
        turn += 1
        wide = {(r.low, r.high): r for r in ranges.values() if r.rows > rank_rows}
        for r in wide.values():
            # hashed anew in each pass, so that the keys drawn before are not drawn again
            rate = max(1, int(min(1.0, 4 * PROBES / r.rows) * scale))
            part = (keys.where(_within(r, o, id_col) & (F.pmod(F.xxhash64(id_col, F.lit(turn)), F.lit(scale)) < rate))
                    .orderBy(F.xxhash64(id_col, F.lit(-turn))).limit(16 * PROBES).collect())
            drawn = sorted({(x[0], x[1]) for x in part}, key=_order)
            if not drawn:
                continue
            probes = [drawn[(i + 1) * len(drawn) // (PROBES + 1)] for i in range(PROBES)] if len(drawn) > PROBES else drawn
            probes = list(dict.fromkeys(probes))
            # number of probes below the row's key, counted in one aggregate
            segment = sum((F.when(_above(p, o, id_col), 1).otherwise(0) for p in probes), F.lit(0))
            sizes = {x["s"]: x["n"] for x in keys.where(_within(r, o, id_col)).groupBy(segment.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
            bounds, below = [r.low, *probes, r.high], r.skip
            for s in range(len(probes) + 1):
                rows = sizes.get(s, 0)
                for p, old in ranges.items():
                    if old is r and below < p <= below + rows:
                        ranges[p] = _Range(bounds[s], bounds[s + 1], below, rows)
                below += rows
            # ranges that were the same object keep sharing one, so that a pass counts them once
            same: dict[tuple, _Range] = {}
            for p, x in ranges.items():
                ranges[p] = same.setdefault((x.low, x.high), x)
    found: dict[int, Key] = {}
    for r in {id(x): x for x in ranges.values()}.values():
        rows = sorted(((x[0], x[1]) for x in keys.where(_within(r, o, id_col)).collect()), key=_order)   # at most rank_rows
        for p, x in ranges.items():
            if x is r:
                found[p] = rows[p - r.skip - 1]
    return [found[p] for p in positions]


def tile_of(cuts: list[Key], spec: NtileSpec, id_col: str) -> Column:
    """1 + the number of cut keys below the row's key."""
    return sum((F.when(_above(c, spec.order_col, id_col), 1).otherwise(0) for c in cuts), F.lit(1)).cast("int")


def add_ntiles(df: DataFrame, specs: list[NtileSpec], id_col: str, *, materialize: bool = True,
               rank_rows: int = 4096) -> DataFrame:
    """Append one INT column per spec: NTILE(k) over (order_col ASC NULLS LAST, id_col).

    The ids are unique and not NULL.  The input is read several times, so by
    default it is first written to the session's checkpoint folder.
    """
    base = reliable_checkpoint(df, "ntile_input") if materialize else df
    n = base.count()
    return base.select("*", *[tile_of(cut_keys(base, s, id_col, n, rank_rows), s, id_col).alias(s.out_col) for s in specs])
