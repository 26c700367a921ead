"""Tables between the steps of a job, kept in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session without one gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="affinis-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


class Workspace:
    """Writes the steps of one job as Parquet under the shared folder and reads them again.

    A written table cuts the lineage and survives the loss of executors. The shuffle files of the job
    that wrote it are given back at its end, since nothing reads them any more. The tables go when the
    Python process ends, because results that the caller holds may still read them; ``close`` removes
    them earlier.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def file_system(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns what was written."""
        path, schema = f"{self.path}/{name}", df.schema
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("error").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(schema).parquet(path)

    def remove(self, name: str) -> None:
        """Removes a table that no later step and no result reads."""
        fs, path = self.file_system()
        fs.delete(path(f"{self.path}/{name}"), True)

    def close(self) -> None:
        try:
            fs, path = self.file_system()
            fs.delete(path(self.path), True)
        except Exception:  # noqa: BLE001  the session is gone; its folder is temporary anyway
            pass


class Folder(Workspace):
    """Tables under a folder that the caller names; they stay until they are removed, and a later session finds them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def names(self) -> list[str]:
        """The tables that are whole."""
        fs, path = self.file_system()
        if not fs.exists(path(self.path)):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(path(self.path)) if fs.exists(path(f"{self.path}/{s.getPath().getName()}/_SUCCESS")))

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df, in place of what a job that died may have left under the name, and returns what was written."""
        self.remove(name)
        return super().table(df, name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def close(self) -> None:
        """Nothing goes."""


def split_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_id(df: DataFrame, rest: str) -> T.StructType:
    """A schema of df's column id, whatever its type, and the columns of a DDL string."""
    return T.StructType([T.StructField("id", df.schema["id"].dataType), *T.StructType.fromDDL(rest).fields])
