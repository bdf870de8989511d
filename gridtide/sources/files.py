"""Questions about folders, asked through the file system Spark itself uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _handle(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _handle(spark, path)
    return system.exists(target)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of visible entries directly below a folder; none if it does not exist."""
    system, target = _handle(spark, path)
    if not system.exists(target):
        return []
    names = [status.getPath().getName() for status in system.listStatus(target)]
    return sorted(name for name in names if not name.startswith((".", "_")))


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that is in it; nothing happens if it does not exist."""
    system, target = _handle(spark, path)
    system.delete(target, True)
