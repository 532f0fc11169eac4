import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from valuemarts.sources.spec import STAGING  # noqa: E402

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]")
         .appName("valuemarts-tests")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vm-test-ckpt-", dir="/tmp"))
    yield s


class FrameStaging:
    """Staging tables from hand-made rows; missing tables are empty."""

    def __init__(self, spark, **rows):
        self._tables = {}
        for name, spec in STAGING.items():
            data = rows.get(name, [])
            self._tables[name] = spark.createDataFrame(data, spec.schema)

    def __getattr__(self, name):
        if name.startswith("stg_") and name in self._tables:
            return self._tables[name]
        raise AttributeError(name)

    def table(self, name):
        return self._tables[name]

    def tables(self):
        return dict(self._tables)


@pytest.fixture
def frames(spark):
    def make(**rows):
        return FrameStaging(spark, **rows)
    return make
