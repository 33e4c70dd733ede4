"""Written tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a private one only where it is unset and all runs in one
    process (tests). A cluster without the setting is an error: its machines don't share a local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _own_dir
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="arborql-", dir="/tmp")
    return _own_dir


class Tables:
    """Intermediate Parquet tables in the shared folder. A written table survives lost executors and
    stops recomputation; ``drop`` frees one that no later plan reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, f"{shared_dir(spark)}/arborql-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.top}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._arborql_path = path
        return out

    def folder(self, name: str) -> str:
        """A place for files of other kinds, freed with the tables."""
        return f"{self.top}/{name}"

    def drop(self, *frames: DataFrame) -> None:
        """Free tables that no later plan reads."""
        for df in frames:
            self._delete(df._arborql_path)

    def clear(self) -> None:
        """Free all of them, once what was made of them is written elsewhere."""
        self._delete(self.top)

    def _delete(self, name: str) -> None:
        path, fs = hadoop_path(self.spark, name)
        fs.delete(path, True)


def hadoop_path(spark: SparkSession, name: str):
    """A path and its file system, of whatever kind Spark knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
