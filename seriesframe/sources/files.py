"""Folders and small files on whatever file system the path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _fs(spark, path)
    return fs.exists(hadoop_path)


def delete(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _fs(spark, path)
    fs.delete(hadoop_path, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    fs, hadoop_path = _fs(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(hadoop_path))


def partitions(spark: SparkSession, path: str, column: str = "day") -> list[str]:
    """Values of the first partition column, read from the directory names."""
    prefix = f"{column}="
    return [name[len(prefix):] for name in names(spark, path) if name.startswith(prefix)]


def modified(spark: SparkSession, path: str) -> int:
    fs, hadoop_path = _fs(spark, path)
    return fs.getFileStatus(hadoop_path).getModificationTime()


def read_text(spark: SparkSession, path: str) -> str:
    fs, hadoop_path = _fs(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not exist yet, whole or not at all; False if another one was first."""
    fs, hadoop_path = _fs(spark, path)
    if fs.exists(hadoop_path):
        return False
    part = spark._jvm.org.apache.hadoop.fs.Path(
        hadoop_path.getParent(), f"_part-{spark._jvm.java.util.UUID.randomUUID()}"
    )
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.rename(part, hadoop_path):
        return True
    fs.delete(part, False)
    return False
