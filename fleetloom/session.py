"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    # wide projections: past this size the JVM no longer compiles the generated method, so let Spark split it
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def prepare_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators are designed for.

    No join hints are set anywhere: Spark broadcasts a side only when its own size estimate (or, under
    adaptive execution, the measured shuffle size) is below ``spark.sql.autoBroadcastJoinThreshold``;
    bigger sides take the sort-merge path, whose hot keys adaptive execution splits.
    """
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only in local sessions that name none."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="fleetloom-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back.

    A lost executor then costs the current step only. Unlike an eager checkpoint the data is computed once, and
    the size of the written files lets Spark choose the joins of the next step.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/fleetloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables written by :func:`cut_lineage` that no later step reads."""
    for table in tables:
        delete_path(table.sparkSession, table.written_path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark reaches."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


# Estimated size from which a derived table is written before it is joined.
UNSETTLED_BYTES = 8 * 1024 * 1024


def settled(df: DataFrame) -> DataFrame:
    """A derived table whose real size Spark can see.

    Aggregates and distincts are estimated as large as their input, so the table they are joined to would be
    shuffled first, however few rows they turn out to have. Above the limit the table is written and read back:
    its file size then decides between a broadcast and a shuffle.
    """
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if estimate <= UNSETTLED_BYTES else cut_lineage(df)
