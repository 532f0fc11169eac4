"""CSV → typed, de-duplicated staging Parquet.

Per table: find ``<stem>.csv`` in the data folder (a missing file is recorded
as skipped), read it with every column as text (so zip prefixes keep their
leading zeros), read the null tokens as NULL, coerce the listed timestamp
columns (a bad value becomes NULL), cast the other columns to the declared
types (a bad value fails the load, as a database insert would), and keep the
first row per primary key in file order.

A load fails, naming table, column and row count, when the file lacks a key
or NOT NULL column or when such a column holds a NULL; other absent columns
are NULL.  Text longer than its VARCHAR(n) is counted, and fails the load too
unless ``enforce_lengths`` is off.

A load writes new version folders and, after the last table, commits one
*snapshot*: a numbered manifest of all nine tables, made visible by a rename.
A table whose CSV is absent keeps the version it has, as a load that finds no
file leaves the rows alone; it is reported as skipped.  Readers pin a snapshot
and so see one set of tables whatever is loaded meanwhile; a load that fails or
dies between two tables leaves the former set.  The snapshot before the current
one is kept for its readers; older ones and their files are deleted by the next
commit, and ``Snapshots.vacuum`` removes what a dead load left.  A table that no snapshot
names was never loaded and cannot be read; one that was only ever skipped reads
as empty.

Tables that meet on the order id are written in buckets of it (``spec``), so
their joins need no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedup import keep_by_position, keep_first, keep_first_dealt
from ..operators.skew import is_spread
from ..session import default_buckets, delete_path, read_bucketed, stored_bytes, write_bucketed
from .snapshots import Snapshots, file_system
from .spec import STAGING, TableSpec

REPORT_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("rows_in", T.LongType(), True),
    T.StructField("rows_dropped", T.LongType(), True),
    T.StructField("rows_out", T.LongType(), True),
])


# Texts that a CSV field may hold for NULL.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


class LoadError(ValueError):
    """A file breaks its table's declared rules."""


def _path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def find_csv(spark: SparkSession, data_dir: str, stem: str) -> str | None:
    """``<data_dir>/<stem>.csv`` if it exists (exact stem), else None."""
    path = f"{data_dir.rstrip('/')}/{stem}.csv"
    return path if _path_exists(spark, path) else None


def read_raw_csv(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """All columns as text.  Quoted fields may hold quotes; only tables with
    free text (review comments) are read with multiLine, which makes a file
    one split — the others stay splittable across tasks."""
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in header])
    raw = (spark.read.schema(schema).option("header", True)
           .option("multiLine", spec.multiline).option("escape", '"').csv(path))
    return with_file_position(raw, path)


# Column that records where a row sits in its source.
POSITION = "_src_position"
_ROW_BITS, _BLOCK_BITS = 33, 44


def _file_numbers(spark: SparkSession, path: str) -> DataFrame | None:
    """(name, number) of a folder's files by name; None for a single file.  As
    many rows as the driver lists files for the scan."""
    fs, p = file_system(spark, path)
    if not fs.getFileStatus(p).isDirectory():
        return None
    names = sorted(str(x.getPath().getName()) for x in fs.listStatus(p))
    return spark.createDataFrame(list(zip(names, range(len(names)))), "_src_name string, _src_number int")


def with_file_position(raw: DataFrame, path: str) -> DataFrame:
    """Number each row by file, split offset and place in the split, packed into
    one decimal that a hash aggregate can take the minimum of.

    Within a task rows are read in file order and ``monotonically_increasing_id``
    grows with them (its low 33 bits count the task's rows); splits of one file
    are ordered by their start offset.  So the number orders rows as they appear
    in the file, and a re-run task reads the same split and assigns the same.
    """
    files = _file_numbers(raw.sparkSession, path)
    tagged = raw.select("*", F.col("_metadata.file_name").alias("_src_name"), F.col("_metadata.file_block_start").alias("_src_block"),
                        F.monotonically_increasing_id().alias("_src_row"))
    if files is None:
        number = F.lit(0)
    else:
        tagged = tagged.join(F.broadcast(files), "_src_name", "left")
        number = F.coalesce("_src_number", F.raise_error(F.concat(F.lit("no number for file "), "_src_name")).cast("int"))
    wide = "decimal(38,0)"
    block = (number.cast("decimal(10,0)") * F.lit(1 << _BLOCK_BITS).cast("decimal(15,0)")).cast(wide) + F.col("_src_block").cast(wide)
    place = F.col("_src_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    packed = (block.cast("decimal(26,0)") * F.lit(1 << _ROW_BITS).cast("decimal(11,0)")).cast(wide) + place.cast(wide)
    return tagged.select(*[F.col(f"`{c}`") for c in raw.columns], packed.cast(wide).alias(POSITION))


def check_columns(raw: DataFrame, spec: TableSpec) -> None:
    """The file must have every key and NOT NULL column."""
    lacking = [c for c in dict.fromkeys((*spec.pk, *spec.not_null)) if c not in raw.columns]
    if lacking:
        raise LoadError(f"{spec.name}: the file has no column {', '.join(lacking)}; it has {', '.join(raw.columns)}")


def coerce(raw: DataFrame, spec: TableSpec, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed projection of a text frame onto the table's declared columns
    (plus the ``keep`` columns, unchanged)."""
    check_columns(raw, spec)
    present = set(raw.columns)
    cols = []
    for c in spec.columns:
        if c.name not in present:
            cols.append(F.lit(None).cast(c.dtype).alias(c.name))
            continue
        text = F.when(~F.col(c.name).isin(*NULL_TOKENS), F.col(c.name))
        if c.name in spec.timestamp_cols:
            cols.append(F.trim(text).try_cast(T.TimestampNTZType()).alias(c.name))
        elif isinstance(c.dtype, T.StringType):
            cols.append(text.alias(c.name))
        else:
            cols.append(F.trim(text).cast(c.dtype).alias(c.name))
    return raw.select(*cols, *[F.col(k) for k in keep])


def as_csv_text(df: DataFrame) -> DataFrame:
    """Every column as the text a CSV export would hold: timestamps as
    'yyyy-MM-dd HH:mm:ss', NULL as an empty string."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        cols.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return df.select(*cols)


def stage(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """Typed table, first row per primary key.  "First" is file order when the
    frame carries file positions (``read_raw_csv``), else the declared order."""
    if not spec.pk:
        return coerce(raw, spec)
    if POSITION in raw.columns:
        return keep_by_position(coerce(raw, spec, keep=(POSITION,)), spec.pk, POSITION).drop(POSITION)
    return keep_first(coerce(raw, spec), spec.pk, spec.keep_first_order())


@dataclass
class LoadResult:
    table_name: str
    status: str
    rows_in: int | None = None
    rows_out: int | None = None

    def row(self):
        dropped = None if self.rows_in is None else self.rows_in - self.rows_out
        return (self.table_name, self.status, self.rows_in, dropped, self.rows_out)


#: bytes of a CSV for one partition of its rows
CSV_SHARE = 32 << 20


# -- versions and snapshots ------------------------------------------------------

def write_version(df: DataFrame, staging_dir: str, table: str, buckets: int | None = None, arranged: bool = False) -> dict:
    """Write a new version folder of the table; returns its snapshot entry.
    ``arranged``: the rows are in ``buckets`` partitions by its bucket column."""
    path, column = Snapshots(df.sparkSession, staging_dir).new_version(table), STAGING[table].bucket_by
    if column is None:
        df.write.parquet(path)
        return {"status": "loaded", "path": path}
    count = buckets or default_buckets(df.sparkSession)
    write_bucketed(df, path, column, count, arranged)
    return {"status": "loaded", "path": path, "bucket_by": column, "buckets": count}


def read_version(spark: SparkSession, table: str, entry: dict) -> DataFrame:
    """A table as a snapshot names it, with its declared schema."""
    schema = STAGING[table].schema
    if entry["status"] == "skipped":
        return spark.createDataFrame([], schema)
    if "buckets" in entry:
        return read_bucketed(spark, entry["path"], schema, entry["bucket_by"], entry["buckets"])
    return spark.read.schema(schema).parquet(entry["path"])


def manifest(spark: SparkSession, staging_dir: str, table: str) -> dict | None:
    """The table's entry in the current snapshot."""
    return Snapshots(spark, staging_dir).current()["tables"].get(table)


def _broken_rules(spec: TableSpec) -> dict[str, tuple[str, F.Column]]:
    rules = {f"null_{c}": (f"NULL in {c}", F.col(c).isNull()) for c in dict.fromkeys((*spec.pk, *spec.not_null))}
    rules |= {f"long_{c.name}": (f"longer than {c.max_length} in {c.name}", F.length(c.name) > c.max_length)
              for c in spec.columns if c.max_length is not None}
    return rules


def csv_buckets(spark: SparkSession, data_dir: str) -> int:
    """Buckets of the tables of a data folder, by its largest CSV."""
    sizes = [stored_bytes(spark, f"{data_dir.rstrip('/')}/{spec.csv_stem}.csv") for spec in STAGING.values()]
    return default_buckets(spark, max(sizes), CSV_SHARE)


def stage_table(spark: SparkSession, data_dir: str, out_dir: str, spec: TableSpec,
                enforce_lengths: bool = True) -> tuple[LoadResult, dict | None]:
    """Write a new version of one table from its CSV, without publishing it;
    returns the report row and the snapshot entry (None: no CSV)."""
    path = find_csv(spark, data_dir, spec.csv_stem)
    if path is None:
        return LoadResult(spec.name, "skipped"), None
    seen = Observation(f"load_{spec.name}")
    rules = _broken_rules(spec)
    # rows read and broken rules are counted on the typed rows, before
    # de-duplication, while the write job runs
    raw = read_raw_csv(spark, path, spec)
    typed = coerce(raw, spec, keep=(POSITION,))
    checked = typed.observe(
        seen, F.count(F.lit(1)).alias("rows_in"), *[F.count(F.when(cond, 1)).alias(k) for k, (_, cond) in rules.items()])
    buckets, dealt = csv_buckets(spark, data_dir), False
    if not spec.pk:
        rows = checked
    elif is_spread(typed, column := spec.bucket_by if spec.bucket_by in spec.pk else spec.pk[0]):
        dealt = column == spec.bucket_by
        count = buckets if spec.bucket_by else max(1, -(-stored_bytes(spark, path) // CSV_SHARE))
        rows = keep_first_dealt(checked, spec.pk, (POSITION,), column, count)
    else:
        rows = keep_by_position(checked, spec.pk, POSITION, keys=typed)
    entry = write_version(rows.drop(POSITION), out_dir, spec.name, buckets, dealt)
    got = seen.get
    broken = [f"{got[k]} rows {what}" for k, (what, _) in rules.items() if got[k] and (enforce_lengths or k.startswith("null_"))]
    if broken:
        delete_path(spark, entry["path"])
        raise LoadError(f"{spec.name}: " + "; ".join(broken))
    entry |= {"rows_in": got["rows_in"], "rows_out": spark.read.parquet(entry["path"]).count()}   # from Parquet footers
    return LoadResult(spec.name, "loaded", entry["rows_in"], entry["rows_out"]), entry


def load_tables(spark: SparkSession, data_dir: str, out_dir: str, specs: Sequence[TableSpec], parallel_jobs: int = 4,
                enforce_lengths: bool = True) -> list[LoadResult]:
    """Stage the tables and commit them as one snapshot; if one fails, nothing
    is published and what the others wrote is deleted."""
    snapshots = Snapshots(spark, out_dir)
    before = snapshots.current()
    with ThreadPoolExecutor(max_workers=parallel_jobs) as pool:
        jobs = [pool.submit(stage_table, spark, data_dir, out_dir, spec, enforce_lengths) for spec in specs]
    written = {job.result()[0].table_name: job.result()[1] for job in jobs if not job.exception() and job.result()[1]}
    try:
        results = [job.result()[0] for job in jobs]                    # raises the first failure
        skipped = {r.table_name: {"status": "skipped"} for r in results
                   if r.status == "skipped" and r.table_name not in before["tables"]}
        snapshots.commit(before, written | skipped)
    except BaseException:
        for entry in written.values():
            delete_path(spark, entry["path"])
        raise
    return results


def load_table(spark: SparkSession, data_dir: str, out_dir: str, spec: TableSpec,
               enforce_lengths: bool = True) -> LoadResult:
    """Load one table; the others stay as they are."""
    return load_tables(spark, data_dir, out_dir, [spec], 1, enforce_lengths)[0]


def load_all(spark: SparkSession, data_dir: str, out_dir: str, parallel_jobs: int = 4,
             enforce_lengths: bool = True) -> DataFrame:
    """Load every staging table; returns the load report.

    The tables are independent jobs, submitted from a few driver threads so
    they share the cluster instead of queueing one after another.
    """
    results = load_tables(spark, data_dir, out_dir, list(STAGING.values()), parallel_jobs, enforce_lengths)
    return spark.createDataFrame([r.row() for r in results], REPORT_SCHEMA)


class ParquetStaging:
    """Staging tables of one snapshot (same interface as the test-data mapping).
    The snapshot is read when the object is made and pinned: a later load does
    not show."""

    def __init__(self, spark: SparkSession, staging_dir: str):
        self.spark = spark
        self.staging_dir = staging_dir.rstrip("/")
        self.snapshot = Snapshots(spark, self.staging_dir).current()
        self._tables: dict[str, DataFrame] = {}

    @property
    def buckets(self) -> int | None:
        """The most buckets that a table is in."""
        return max((e["buckets"] for e in self.snapshot["tables"].values() if "buckets" in e), default=None)

    def table(self, name: str) -> DataFrame:
        """The table's pinned version; one that was only ever skipped is empty."""
        if name not in self._tables:
            if name not in self.snapshot["tables"]:
                raise LoadError(f"{name} was never loaded into {self.staging_dir}")
            self._tables[name] = read_version(self.spark, name, self.snapshot["tables"][name])
        return self._tables[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in STAGING:
            return self.table(name)
        raise AttributeError(name)

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in STAGING}
