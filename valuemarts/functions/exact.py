"""Exact rounding of averages and percentages.

The reference divides in arbitrary-precision numerics and rounds half away
from zero.  Spark's decimal division keeps as few as 6 fraction digits and a
double average rounds twice, so every average or rate in the marts is written
as a ratio of two integers and rounded here with integer arithmetic only:

    round(num / den, k) = sign(num) * ((2 * 10^k * |num| + den) div (2 * den)) / 10^k

``num`` and ``den`` are integral columns (counts, day sums, cents).  The result
is NULL when ``den`` is 0 or NULL or when ``num`` is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT38 = "decimal(38,0)"
MONEY = "decimal(38,2)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio_round(num, den, k: int) -> Column:
    """``num / den`` rounded half away from zero to ``k`` places, as DOUBLE."""
    n = _col(num).cast(INT38)
    d = F.nullif(_col(den).cast(INT38), F.lit(0).cast(INT38))
    scale = 10 ** k
    q = F.call_function("div", F.abs(n) * F.lit(2 * scale) + d, d * F.lit(2))
    # sign applied to the integer, so a value that rounds to zero is +0.0
    signed = F.when(n < 0, -q).otherwise(q)
    return (signed.cast("double") / F.lit(float(scale))).cast("double")


def cents(money) -> Column:
    """A 2-place money value as an exact integer number of cents."""
    return (_col(money).cast(MONEY) * F.lit(100)).cast(INT38)


def round_money(money, k: int = 2) -> Column:
    """ROUND(sum, k) of an exact decimal, half away from zero, as DOUBLE."""
    return F.round(_col(money).cast(MONEY), k).cast("double")


def exact_hundredths(x) -> Column:
    """A DOUBLE that holds a 2-place value (e.g. a rounded rate) → integer hundredths."""
    return F.round(_col(x).cast(MONEY) * F.lit(100)).cast(INT38)
