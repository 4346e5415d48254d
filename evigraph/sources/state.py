"""Lineage cuts and versioned state in the folder that a cluster shares."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def state_dir(spark: SparkSession) -> str:
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="evigraph-")
    return _own[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Written and read again, so that plans don't grow with the rounds."""
    path = f"{state_dir(df.sparkSession)}/evigraph-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class StateStore:
    """Tables in numbered versions; a manifest names the version that counts, and replacing it is the commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, name: str):
        return self._path(f"{self.root}/{name}.json")

    def version(self, name: str) -> int | None:
        if not self._fs.exists(self._manifest(name)):
            return None
        return json.loads(self.spark.sparkContext.wholeTextFiles(str(self._manifest(name))).first()[1])["version"]

    def read(self, name: str) -> DataFrame | None:
        v = self.version(name)
        return None if v is None else self.spark.read.parquet(f"{self.root}/{name}/v={v}")

    def replace(self, name: str, df: DataFrame) -> int:
        """A crash at any point leaves the old version or the new one, never none."""
        from evigraph.sources.feeds import put_text

        v = (self.version(name) or 0) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={v}")
        put_text(self.spark, f"{self.root}/{name}.json", json.dumps({"version": v}))
        return v
