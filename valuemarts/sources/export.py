"""Mart exports (Parquet, one folder per mart) and reading them back.

An export writes every mart to a new version folder and then publishes them as
one snapshot that records each mart's rows, order and content hash; a reader
follows the snapshot.  So the marts a reader sees belong together, and an
export that fails leaves the former one readable.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path
from .snapshots import Snapshots, file_system, rename


class ExportError(RuntimeError):
    """An exported mart is absent or not what the snapshot says."""


def _content(df: DataFrame) -> dict:
    """Rows and a hash that depends on the rows alone, not on their order."""
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.lit(0)
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(whole.cast("decimal(38,0)")).alias("hash")).first()
    return {"rows": r["rows"], "hash": str(r["hash"] or 0)}


def export_mart(df: DataFrame, path: str, single_file: bool = True) -> dict:
    """Write the mart to a new folder; returns its snapshot entry.

    Marts are aggregated and small, so by default they are written as one
    file, in the mart's order if it has one: a sorted mart's partitions follow
    each other in one task.
    """
    (df.coalesce(1) if single_file else df).write.parquet(path)
    return {"path": path} | _content(df.sparkSession.read.parquet(path))


def export_marts(marts: Mapping[str, DataFrame], out_dir: str, parallel_jobs: int = 4,
                 order: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Export every mart, from a few driver threads, and publish them together;
    returns (mart, rows) for the export log.  ``order``: sort columns to record."""
    spark = next(iter(marts.values())).sparkSession
    snapshots = Snapshots(spark, out_dir)
    before = snapshots.current()
    paths = {name: snapshots.new_version(name) for name in marts}
    try:
        with ThreadPoolExecutor(max_workers=parallel_jobs) as pool:
            entries = dict(zip(marts, pool.map(lambda name: export_mart(marts[name], paths[name]), marts)))
        for name, columns in (order or {}).items():
            if name in entries:
                entries[name]["order"] = list(columns)
        snapshots.commit(before, entries)
    except BaseException:
        for path in paths.values():
            delete_path(spark, path)
        raise
    return spark.createDataFrame([(name, e["rows"]) for name, e in entries.items()], "mart string, rows long")


#: cached marts: (folder, mart) -> (version path, frame)
_CACHED: dict[tuple[str, str], tuple[str, DataFrame]] = {}


def load_mart(spark: SparkSession, out_dir: str, name: str, cache: bool = True, verify: bool = False) -> DataFrame:
    """The mart as last exported.  A cached one stays cached until a later
    export replaces it or :func:`release_marts`; ``verify`` recounts it."""
    entry = Snapshots(spark, out_dir).current()["tables"].get(name)
    if entry is None:
        raise ExportError(f"{name} was never exported to {out_dir}")
    held = _CACHED.get((out_dir, name))
    if held and (held[0] != entry["path"] or held[1].sparkSession is not spark):
        held[1].unpersist()
        held = _CACHED.pop((out_dir, name)) and None
    df = held[1] if held and cache else spark.read.parquet(entry["path"])
    if verify and (found := _content(df)) != {k: entry[k] for k in ("rows", "hash")}:
        raise ExportError(f"{name}: the files hold {found}, the snapshot says {entry['rows']} rows, hash {entry['hash']}")
    if cache and not held:
        _CACHED[out_dir, name] = entry["path"], df.cache()
    return df


def release_marts(out_dir: str | None = None) -> None:
    """Drop the cached marts (of one folder, or all)."""
    for key in [k for k in _CACHED if out_dir is None or k[0] == out_dir]:
        _CACHED.pop(key)[1].unpersist()


def with_position(mart: DataFrame) -> DataFrame:
    """Rows of a mart read back from its one file, with their position in it."""
    return mart.withColumn("position", F.monotonically_increasing_id() + 1)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header row (the dashboard's table download).  It is written
    beside the former one, which goes only when the new one is whole."""
    spark, path = df.sparkSession, path.rstrip("/")
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    try:
        df.coalesce(1).write.option("header", True).csv(new)
    except BaseException:
        delete_path(spark, new)
        raise
    fs, p = file_system(spark, path)
    former = fs.exists(p) and rename(spark, path, old)
    if not rename(spark, new, path):
        if former:
            rename(spark, old, path)
        delete_path(spark, new)
        raise ExportError(f"{path} could not be replaced")
    if former:
        delete_path(spark, old)


def ordered(df: DataFrame, *columns: str) -> DataFrame:
    """Sort a mart by the columns; ``-name`` is descending with NULLs first."""
    return df.orderBy(*[F.col(c[1:]).desc_nulls_first() if c.startswith("-") else F.col(c).asc_nulls_first() for c in columns])
