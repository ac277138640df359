"""Where intermediate tables live, and the session settings every operator relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings (UTC days, adaptive plans) to a session."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="taxatrend-")
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


class Workspace:
    """Tables written once and read many times, under one folder of the shared root."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = configure(spark)
        self.root = root or f"{shared_root(spark)}/taxatrend-{uuid.uuid4().hex[:12]}"
        self._tables: dict[str, DataFrame] = {}
        #: Names of other outputs already written under this workspace.
        self.marks: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, build, partition_by: str | None = None) -> DataFrame:
        """A table of this workspace, written from ``build()`` on first use.

        Being files, tables have known sizes: the optimizer broadcasts a dimension while it is small and
        stops doing so by itself when it is not.
        """
        if name not in self._tables:
            write(build(), self.path(name), partition_by)
            self._tables[name] = self.spark.read.parquet(self.path(name))
        return self._tables[name]


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` as files in the shared folder, for inputs that one operator reads several times."""
    path = f"{shared_root(df.sparkSession)}/taxatrend-once/{name}-{uuid.uuid4().hex[:12]}"
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    """Write Parquet in evenly sized files; a partition value that dominates is split, not one task."""
    if partition_by:
        df.hint("rebalance", partition_by).write.mode(mode).partitionBy(partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a scratch copy that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
