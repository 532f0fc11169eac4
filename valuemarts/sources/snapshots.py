"""Numbered snapshots of a set of written tables.

A snapshot is a JSON file that names each table's version folder.  It becomes
visible by one rename after all its tables are written, is never changed, and
the highest number is the current one.  So a reader that holds a snapshot sees
one consistent set, and a writer that fails or dies leaves the former set.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import SparkSession

from ..session import delete_path


class SnapshotConflict(RuntimeError):
    """Another writer committed the next snapshot meanwhile."""


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def rename(spark: SparkSession, old: str, new: str) -> bool:
    fs, p = file_system(spark, old)
    return fs.rename(p, file_system(spark, new)[1])


class Snapshots:
    """The snapshots below ``root``.  The last ``keep`` stay readable; older
    ones, and the versions that only they name, go with the next commit."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self.folder = f"{self.root}/_snapshots"

    def _numbered(self) -> list[tuple[int, str]]:
        fs, p = file_system(self.spark, self.folder)
        if not fs.exists(p):
            return []
        names = [str(x.getPath().getName()) for x in fs.listStatus(p)]
        return sorted((int(n[:-5]), f"{self.folder}/{n}") for n in names if re.fullmatch(r"\d+\.json", n))

    def _read(self, path: str) -> dict:
        fs, p = file_system(self.spark, path)
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> dict:
        """The latest snapshot: ``number`` and ``tables`` (0 and none at first)."""
        found = self._numbered()
        return self._read(found[-1][1]) | {"number": found[-1][0]} if found else {"number": 0, "tables": {}}

    def new_version(self, table: str) -> str:
        return f"{self.root}/{table}/v-{uuid.uuid4().hex}"

    def commit(self, before: dict, entries: dict[str, dict]) -> int:
        """Publish ``before`` with the new ``entries`` as the next snapshot.  Of
        two writers that started from one snapshot, the second one fails."""
        number = before["number"] + 1
        fs, part = file_system(self.spark, f"{self.folder}/{uuid.uuid4().hex}.part")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps({"tables": before["tables"] | entries}).encode()))
        out.close()
        _, final = file_system(self.spark, f"{self.folder}/{number:08d}.json")
        if fs.exists(final) or not fs.rename(part, final):
            fs.delete(part, False)
            raise SnapshotConflict(f"another writer committed snapshot {number} of {self.root} meanwhile")
        self._expire()
        return number

    @staticmethod
    def _paths(snapshot: dict) -> set[str]:
        return {e["path"] for e in snapshot["tables"].values() if "path" in e}

    def _expire(self) -> None:
        found = self._numbered()
        kept = set().union(*(self._paths(self._read(p)) for _, p in found[-self.keep:]))
        for _, path in found[:-self.keep]:
            for version in self._paths(self._read(path)) - kept:
                delete_path(self.spark, version)
            delete_path(self.spark, path)

    def vacuum(self, older_than_hours: float = 24.0) -> list[str]:
        """Delete version folders that no snapshot names (a dead writer left
        them) and that are older than any writer may take; returns their paths."""
        named = set().union(*(self._paths(self._read(p)) for _, p in self._numbered()), set())
        named = {"/".join(p.rsplit("/", 2)[-2:]) for p in named}
        limit = (time.time() - 3600 * older_than_hours) * 1000
        gone = []
        fs, root = file_system(self.spark, self.root)
        for table in fs.listStatus(root) if fs.exists(root) else []:
            if not table.isDirectory() or str(table.getPath().getName()).startswith("_"):
                continue
            for x in fs.listStatus(table.getPath()):
                name = f"{table.getPath().getName()}/{x.getPath().getName()}"
                if x.getPath().getName().startswith("v-") and name not in named and x.getModificationTime() <= limit:
                    fs.delete(x.getPath(), True)
                    gone.append(name)
        return sorted(gone)
