"""Operator 3: cross-site boilerplate lines by distinct-site spread.

A line (trimmed of ASCII blanks and tabs, not empty) is boilerplate if it
stands on at least ``min_sites`` distinct sites.  Sites per line are first
estimated with HyperLogLog sketches kept as rows: a site sets one of 64
registers of a line, registers merge by max, and the sketches of all
partitions merge in the same aggregation.  Lines estimated within
``band`` standard errors of the threshold get exact distinct counts; the
estimate alone settles the rest.  With the defaults a line on 10 sites is lost
only if these fall in 3 of the 64 registers (probability 2e-9).

A document loses its boilerplate lines wherever they stand; a text that has no
other line is left whole.  ``max_removed`` can also spare documents of which
such lines make up more than a share of the characters.  Nothing else of a text
changes.

Edge cases: null and empty texts have no lines and stay as they are; a null
site counts as no site; repeated rows count one site; ids take no part in the
counting, and rows with null or repeated ids are cleaned like all others;
lines of any length count whole; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuemarts.llm.common import Scratch

REGISTERS = 64
#: fixed values: bias constant of 64 registers; standard error 1.04 / sqrt(registers)
ALPHA, ERROR = 0.709, 0.13


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """Hash of a trimmed line; null for an empty one."""
    t = F.trim(line, F.lit(" \t\r"))
    return F.when(t != "", F.xxhash64(t))


def estimates(pairs: DataFrame) -> DataFrame:
    """(line, site) rows -> (line, estimate): HyperLogLog with linear counting
    for the sparse range."""
    h = F.xxhash64("site", F.lit(17))
    rest = h.bitwiseAND(F.lit((1 << 58) - 1))
    # rank: position of the first set bit of the remaining 58 bits
    rank = F.when(rest == 0, 59).otherwise(58 - F.floor(F.log2(rest.cast("double"))).cast("int"))
    registers = (pairs.select("line", F.shiftrightunsigned(h, 58).cast("int").alias("r"), rank.alias("rank"))
                 .groupBy("line", "r").agg(F.max("rank").alias("rank")))
    sums = registers.groupBy("line").agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count("*").alias("used"))
    empty = F.lit(REGISTERS) - F.col("used")
    raw = F.lit(ALPHA * REGISTERS * REGISTERS) / (F.col("s") + empty)
    return sums.select("line", F.when((raw <= 2.5 * REGISTERS) & (empty > 0), REGISTERS * F.log(REGISTERS / empty)).otherwise(raw).alias("estimate"))


def boilerplate(docs: DataFrame, min_sites: int = 10, band: float = 5.0, text: str = "text", site: str = "source") -> DataFrame:
    """(line): hashes of the lines on at least ``min_sites`` sites."""
    pairs = (docs.select(F.explode(F.array_distinct(F.transform(_lines(F.col(f"`{text}`").cast("string")), _key))).alias("line"),
                         F.col(f"`{site}`").cast("string").alias("site")).where("line is not null and site is not null"))
    with Scratch(docs.sparkSession, "line-dedup") as tmp:
        # a site sets one register, so a line with few sites keeps a low estimate
        low, high = min_sites * (1 - band * ERROR), min_sites * (1 + band * ERROR)
        seen = tmp.write(estimates(pairs).where(F.col("estimate") >= low), "spread")
        near = seen.where(F.col("estimate") < high).select("line")
        exact = (pairs.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("n"))
                 .where(F.col("n") >= min_sites).select("line"))
        return tmp.write(seen.where(F.col("estimate") >= high).select("line").union(exact), "boilerplate", keep=True)


def clean(docs: DataFrame, min_sites: int = 10, max_removed: float | None = None, band: float = 5.0, text: str = "text",
          site: str = "source") -> DataFrame:
    """``docs`` with the text cleaned, all columns kept, and the columns
    __lines_removed and __chars_removed added."""
    lines = boilerplate(docs, min_sites, band, text, site)
    body = F.col(f"`{text}`").cast("string")
    # a line's hash decides alone, so documents are tied to the hashes that they hold
    tagged = docs.withColumn("__row", F.struct(F.xxhash64(body), F.crc32(body.cast("binary"))))
    held = (docs.select(F.struct(F.xxhash64(body), F.crc32(body.cast("binary"))).alias("__row"),
                        F.explode(F.array_distinct(F.transform(_lines(body), _key))).alias("line"))
            .where("line is not null").join(lines, "line").groupBy("__row").agg(F.collect_set("line").alias("__drop")))
    # written first: a text with thousands of copies is then a skewed join, which Spark splits
    held = Scratch(docs.sparkSession, "line-dedup").write(held, "held", keep=True)
    joined = tagged.join(held, "__row", "left")
    drop = F.coalesce("__drop", F.array().cast("array<bigint>"))
    gone = F.filter(_lines(body), lambda x: F.coalesce(F.array_contains(drop, _key(x)), F.lit(False)))
    chars = F.aggregate(gone, F.lit(0), lambda a, x: a + F.length(x))
    joined = joined.withColumns({"__n": F.when(F.col("__drop").isNull(), 0).otherwise(F.size(gone)),
                                 "__c": F.when(F.col("__drop").isNull(), 0).otherwise(chars)})
    own = F.exists(_lines(body), lambda x: _key(x).isNotNull() & ~F.coalesce(F.array_contains(drop, _key(x)), F.lit(False)))
    cut = (F.col("__n") > 0) & own
    if max_removed is not None:
        cut = cut & (F.col("__c") <= max_removed * F.length(body))
    kept = F.array_join(F.filter(_lines(body), lambda x: ~F.coalesce(F.array_contains(drop, _key(x)), F.lit(False))), "\n")
    return joined.select(*[F.when(cut, kept).otherwise(F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
                         F.when(cut, F.col("__n")).otherwise(0).alias("__lines_removed"),
                         F.when(cut, F.col("__c")).otherwise(0).alias("__chars_removed"))
