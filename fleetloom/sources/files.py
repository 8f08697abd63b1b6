"""Small files on any file system that Spark reaches: what manifests are made of."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _reached(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it is not there."""
    system, target = _reached(spark, folder)
    return [entry.getPath().getName() for entry in system.listStatus(target)] if system.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str:
    system, target = _reached(spark, path)
    stream = system.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the path, then rename: a reader sees the old file or the whole new one."""
    system, target = _reached(spark, path)
    _, beside = _reached(spark, f"{path}.tmp")
    stream = system.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if system.exists(target):
        system.delete(target, False)
    if not system.rename(beside, target):
        raise OSError(f"cannot rename to {path}")
