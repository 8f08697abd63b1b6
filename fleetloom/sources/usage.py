"""Container usage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.sources.snapshots import load_snapshot


def flatten_usage(reports: DataFrame) -> DataFrame:
    """One row per container sample, with the timestamp of its report."""
    return reports.select("namespace", "pod", "ts", F.explode("containers").alias("c")).select(
        "namespace", "pod", F.col("c.name").alias("container"), "ts", F.col("c.cpu"), F.col("c.memory")
    )


def read_usage(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return flatten_usage(load_snapshot(spark, "usage_reports", path, fmt))
