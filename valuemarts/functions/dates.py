"""Date helpers matching the reference's PostgreSQL date arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_diff(later, earlier) -> Column:
    """``later::date - earlier::date`` as INT days (NULL if either is NULL)."""
    return F.datediff(F.to_date(_col(later)), F.to_date(_col(earlier))).cast("int")


def month_start(ts) -> Column:
    """``DATE_TRUNC('month', ts)::date``."""
    return F.trunc(F.to_date(_col(ts)), "MM")


def month_number(later_month, earlier_month) -> Column:
    """Whole months between two first-of-month dates.

    Equals ``EXTRACT(YEAR FROM AGE(a, b)) * 12 + EXTRACT(MONTH FROM AGE(a, b))``
    because both inputs are the first day of a month.
    """
    a, b = _col(later_month), _col(earlier_month)
    return ((F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b))).cast("int")


def year_month_text(d) -> Column:
    """``TO_CHAR(d, 'YYYY-MM')``."""
    return F.date_format(_col(d), "yyyy-MM")
