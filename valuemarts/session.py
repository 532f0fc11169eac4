"""Spark session and checkpoint-folder helpers.

Library functions never create a session themselves; they take the one the
caller has.  ``local_session`` is for tests, the bench and command-line use.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every run of the marts relies on.  AQE re-plans joins and
# partition counts at run time and splits skewed join partitions.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int = 8, shuffle_partitions: int = 8,
                  app: str = "valuemarts") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables.

    The SparkContext's checkpoint folder or the session's
    ``spark.checkpoint.dir``.  Where neither is set, a session whose tasks run
    in this very process (``local`` or ``local[n]``, as in tests) gets a
    private temporary folder; any other master must name a shared folder,
    since a machine-local one is not seen by other executors.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; name a shared folder (HDFS/S3/...) "
            "that all executors can reach")
    folder = tempfile.mkdtemp(prefix="valuemarts-ckpt-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df, label: str = "table", bucket_by: str | None = None, arranged: bool = False, buckets: int | None = None):
    """Write ``df`` as a Parquet table in the session's checkpoint folder and
    return ``(DataFrame reading it, path)`` — lineage cut in one job.  With
    ``bucket_by`` the table is bucketed (see :func:`write_bucketed`), in ``buckets``
    or as many as :func:`default_buckets`.

    ``Dataset.checkpoint(eager=True)`` would compute the plan twice (a count,
    then the checkpoint write) and store row-serialised files.  The folder is
    shared storage on a cluster, so a lost executor loses nothing.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/valuemarts/{label}-{uuid.uuid4().hex}"
    if bucket_by is None:
        df.write.mode("error").parquet(path)
        return spark.read.schema(df.schema).parquet(path), path
    count = buckets or default_buckets(spark)
    write_bucketed(df, path, bucket_by, count, arranged)
    return read_bucketed(spark, path, df.schema, bucket_by, count), path


def reliable_checkpoint(df, label: str = "table"):
    """:func:`materialize`, returning only the DataFrame."""
    return materialize(df, label)[0]


# -- bucketed tables -----------------------------------------------------------

#: bytes of Parquet input for one bucket: about a million rows of the longest table
BUCKET_BYTES = 16 << 20


def default_buckets(spark: SparkSession, size: int = 0, share: int = BUCKET_BYTES) -> int:
    """Tables that are to meet without a shuffle need equal bucket counts, so
    all of a context's follow ``spark.sql.shuffle.partitions``, or the largest
    table's ``size`` in bytes where that makes more than ``share`` a bucket: a
    bucket's sort then fits a task's memory whatever the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // share))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder (any Hadoop file system); 0 if it is absent."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def write_bucketed(df, path: str, column: str, count: int, arranged: bool = False) -> None:
    """Write ``df`` to ``path`` in ``count`` buckets of ``column``, one sorted
    file each: rows are shuffled once, here, by the hash that Spark's joins
    use, unless they are ``arranged`` so (``count`` partitions by ``column``).

    Only tables of a catalog carry a bucket layout, so an entry is made for
    the write and dropped again; the files are outside the warehouse and stay.
    """
    spark, name = df.sparkSession, f"valuemarts_{uuid.uuid4().hex}"
    rows = df if arranged else df.repartition(count, column)
    rows.write.format("parquet").bucketBy(count, column).sortBy(column).option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")


def read_bucketed(spark: SparkSession, path: str, schema, column: str, count: int):
    """The table at ``path`` with its bucket layout: joins and aggregations by
    ``column`` with tables of the same layout need no exchange."""
    name = f"valuemarts_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{column}`) SORTED BY (`{column}`) INTO {count} BUCKETS "
              f"LOCATION '{place}'")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder written by :func:`materialize` (any Hadoop file system)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
