"""Data-quality checks for the rules the reference's database enforces (or
announces) on its staging tables: primary keys, NOT NULL, VARCHAR lengths and
NUMERIC ranges, and the announced foreign keys.

Each check returns a small DataFrame of counts (one row per table, column or
edge), computed in one aggregation pass per table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.spec import FOREIGN_KEYS, STAGING, decimal_limit


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def pk_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table with a PK: keys that occur more than once and the surplus rows."""
    out = []
    for name, spec in STAGING.items():
        if not spec.pk or name not in tables:
            continue
        per_key = tables[name].groupBy(*spec.pk).agg(F.count(F.lit(1)).alias("n"))
        dup = per_key.where(F.col("n") > 1).agg(
            F.count(F.lit(1)).alias("duplicate_keys"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
        out.append(dup.select(F.lit(name).alias("table_name"),
                              F.col("duplicate_keys").cast("long").alias("duplicate_keys"),
                              F.col("duplicate_rows").cast("long").alias("duplicate_rows")))
    return _union(out)


def _rules(spec) -> list[tuple[str, str, F.Column]]:
    """(column, rule, broken) of a table: NOT NULL, VARCHAR(n), NUMERIC(p, s)."""
    rules = [(c, "not null", F.col(c).isNull()) for c in spec.not_null]
    for c in spec.columns:
        if c.max_length is not None:
            rules.append((c.name, f"length>{c.max_length}", F.length(F.col(c.name)) > c.max_length))
        limit = decimal_limit(c.dtype)
        if limit is not None:
            rules.append((c.name, f"abs>={limit:g}", F.abs(F.col(c.name)) >= F.lit(limit)))
    return rules


def column_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table, column and rule: rows that break it, counted in one scan per table."""
    out = []
    for name, spec in STAGING.items():
        rules = _rules(spec)
        if not rules or name not in tables:
            continue
        counts = tables[name].agg(*[F.count(F.when(broken, 1)).alias(f"r{i}") for i, (_, _, broken) in enumerate(rules)])
        rows = F.array(*[F.struct(F.lit(col).alias("column_name"), F.lit(rule).alias("rule"),
                                  F.col(f"r{i}").cast("long").alias("violations"))
                         for i, (col, rule, _) in enumerate(rules)])
        out.append(counts.select(F.explode(rows).alias("m"))
                   .select(F.lit(name).alias("table_name"), "m.column_name", "m.rule", "m.violations"))
    return _union(out)


def null_counts(violations: DataFrame) -> DataFrame:
    """NOT NULL columns: rows where they are NULL (from :func:`column_violations`)."""
    return (violations.where(F.col("rule") == "not null")
            .select("table_name", "column_name", F.col("violations").alias("null_count")))


def domain_violations(violations: DataFrame) -> DataFrame:
    """Values that would not fit VARCHAR(n)/CHAR(n) or NUMERIC(p,s)."""
    return violations.where(F.col("rule") != "not null")


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Per announced foreign key: child rows (and distinct keys) with no parent.

    The child side is first counted per key (combined map-side), so a key
    that holds a large share of the child rows becomes one row before the
    anti join's shuffle.
    """
    out = []
    for child, ccol, parent, pcol in FOREIGN_KEYS:
        if child not in tables or parent not in tables:
            continue
        per_key = tables[child].groupBy(F.col(ccol).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        keys = tables[parent].select(F.col(pcol).alias("k"))
        missing = per_key.join(keys, "k", "left_anti")
        out.append(missing.agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("orphan_rows"),
            F.count(F.lit(1)).cast("long").alias("orphan_keys"))
            .select(F.lit(f"{child}.{ccol} -> {parent}.{pcol}").alias("edge"),
                    "orphan_rows", "orphan_keys"))
    return _union(out)
