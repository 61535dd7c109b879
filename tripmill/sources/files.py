"""Folders of the lake through Hadoop's file system interface, with the credentials of the session."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


def filesystem(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    found, hadoop_path = filesystem(spark, path)
    return found.exists(hadoop_path)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly below a folder; none where it is missing."""
    found, hadoop_path = filesystem(spark, path)
    return sorted(status.getPath().getName() for status in found.listStatus(hadoop_path)) if found.exists(hadoop_path) else []


def delete(spark: SparkSession, path: str) -> None:
    found, hadoop_path = filesystem(spark, path)
    found.delete(hadoop_path, True)


def claim(spark: SparkSession, path: str) -> bool:
    """Create a file that nobody else has created; False where somebody has."""
    found, hadoop_path = filesystem(spark, path)
    found.mkdirs(hadoop_path.getParent())
    return bool(found.createNewFile(hadoop_path))


def age(spark: SparkSession, path: str) -> float:
    """Seconds since a file was last changed, by the clock of this machine."""
    found, hadoop_path = filesystem(spark, path)
    return time.time() - found.getFileStatus(hadoop_path).getModificationTime() / 1000


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    found, hadoop_path = filesystem(spark, path)
    stream = found.create(hadoop_path, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
