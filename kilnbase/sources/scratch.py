"""A folder that driver and executors share, for stream checkpoints and written results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_top(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, else a folder set with `setCheckpointDir`; a session that has neither gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not kept.isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kilnbase-"))
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    return kept.get().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_top(spark)}/{name}-{uuid.uuid4().hex}"


def is_folder(spark: SparkSession, path: str) -> bool:
    """Asked of the file system that Spark reads the path with."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def is_there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder once nothing reads it any more."""
    if not path.startswith(shared_top(spark) + "/"):
        raise ValueError(f"not in the shared folder: {path}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
