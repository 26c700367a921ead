"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; only a local session without one takes a temporary folder, once."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="affinis-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def paths(spark: SparkSession, path: str):
    """(file system, path) of Spark's own access to a path, whatever store it is in."""
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = paths(spark, path)
    return fs.exists(at)


def _clean() -> None:
    for spark, path in _written:
        try:
            fs, at = paths(spark, path)
            fs.delete(at, True)
        except Exception:  # noqa: BLE001  the session is gone; so is what only it could reach
            pass


atexit.register(_clean)


#: Rows that a task of ``dealt`` takes.
TASK_ROWS = 500_000


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Tasks for as many rows as df has, ``rows`` each, and as many as the session shuffles into at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / rows))


def dealt(df: DataFrame, *keys: Column | str, tasks: int | None = None) -> DataFrame:
    """df by its keys over tasks that grow in number with it, so that none of them grows; its rows are counted for that.

    A fixed number of shuffle partitions would let each task take more memory the larger the table is.
    """
    return df.repartition(tasks or tasks_for(df), *keys)


def kept_parts(df: DataFrame, *by: str) -> str:
    """Where the rows were written, in a folder for each value of ``by``; they go when the process ends."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    _written.append((df.sparkSession, path))
    df.write.mode("error").partitionBy(*by).parquet(path)
    return path


def kept_path(df: DataFrame) -> str:
    """Where the rows were written; they go when the process ends."""
    return kept_parts(df)


def kept(df: DataFrame) -> DataFrame:
    """The rows, written once and read again, without the plan that made them; they go when the process ends."""
    return df.sparkSession.read.schema(df.schema).parquet(kept_path(df))
