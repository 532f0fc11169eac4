"""Display labels built from exact integers.

Float formatting rounds differently in every engine (Java's Formatter rounds
the decimal expansion half-up, C/Python round the binary value half-even), so
labels are assembled from integers that were rounded exactly first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exact import INT38, ratio_round


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def thousands(x) -> Column:
    """Integer-valued column → text with a thousands separator ('12,345')."""
    v = _col(x).cast("long")
    return F.format_number(v, 0)


def whole_units(x) -> Column:
    """Round a 2-place value half away from zero to a whole number (long)."""
    return F.round(_col(x).cast("decimal(38,2)"), 0).cast("long")


def one_place_text(x, signed: bool = False) -> Column:
    """A 2-place value rounded half away from zero to 1 place, as text.

    ``signed`` prefixes '+' for values >= 0, as Python's ``{:+.1f}`` does.
    """
    tenths = ratio_round(F.round(_col(x).cast("decimal(38,2)") * 100).cast(INT38), F.lit(10), 0)
    t = tenths.cast("long")
    mag = F.abs(t)
    body = F.concat(F.floor(mag / 10).cast("string"), F.lit("."), (mag % 10).cast("string"))
    sign = F.when(t < 0, F.lit("-")).otherwise(F.lit("+") if signed else F.lit(""))
    return F.concat(sign, body)
