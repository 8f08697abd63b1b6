"""Snapshot tables: readers with explicit schemas, scans, flatteners and the change-only writer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetloom.constants import IMAGE_SOURCE_LABEL
from fleetloom.schemas import SCHEMAS

CORRUPT = "_corrupt_record"

# Fixed value: the event fields kept at ingest.
EVENT_FIELDS = (
    "event_id",
    "namespace",
    "involved_kind",
    "involved_uid",
    "type",
    "reason",
    "message",
    "last_ts",
    "change_op",
)


def load_snapshot(spark: SparkSession, kind: str, path: str, fmt: str = "parquet") -> DataFrame:
    """All objects of one type in all namespaces. Bad JSON rows are kept in ``_corrupt_record``, not lost."""
    schema = T.StructType.fromDDL(SCHEMAS[kind])
    if fmt == "json":
        schema = schema.add(CORRUPT, T.StringType())
        reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        return reader.schema(schema).json(path)
    return spark.read.schema(schema).format(fmt).load(path)


def in_namespace(df: DataFrame, namespace: str) -> DataFrame:
    return df.filter(F.col("namespace") == namespace)


def get_by_key(df: DataFrame, namespace: str, name: str) -> DataFrame:
    return df.filter((F.col("namespace") == namespace) & (F.col("name") == name))


def lookup_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Batch point lookup: every asked (namespace, name) once, with ``found`` telling missing objects apart."""
    asked = keys.select("namespace", "name").distinct()
    return asked.join(df.withColumn("found", F.lit(True)), ["namespace", "name"], "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def labelled_source(df: DataFrame, key: str = IMAGE_SOURCE_LABEL, value: str = "true") -> DataFrame:
    """Objects carrying the label. Store the label as a column at ingest to let Parquet prune on it."""
    return df.filter(F.try_element_at("labels", F.lit(key)) == value)


def warning_events(df: DataFrame) -> DataFrame:
    return df.filter(F.col("type") == "Warning")


def prune_events(df: DataFrame) -> DataFrame:
    """Keep the event fields the operators read; applying it twice changes nothing."""
    return df.select(*EVENT_FIELDS)


def secret_metadata(df: DataFrame) -> DataFrame:
    """Names, labels and annotations; the value column is never read."""
    return df.select("namespace", "name", "labels", "annotations")


def flatten_options(kinds: DataFrame, lists: dict[str, str]) -> DataFrame:
    """One row per option of each list column (``{"image": "image_values", ...}``), order kept.

    A kind without options keeps one row with a null position.
    """
    parts = [
        kinds.select(
            F.col("name").alias("kind"),
            F.lit(option_type).alias("option_type"),
            F.posexplode_outer(column).alias("pos", "option"),
        ).select("kind", "option_type", F.col("pos").cast("bigint").alias("pos"), "option.*")
        for option_type, column in lists.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def flatten_mounts(workspaces: DataFrame, home_path: Column) -> DataFrame:
    """Home, data and secret mounts as rows, from one pass over the workspaces; null read-only is false."""

    def mount(source: str, target: Column, path: Column, read_only: Column, pos: Column) -> Column:
        return F.struct(
            F.lit(source).alias("source"),
            target.alias("target"),
            path.alias("mount_path"),
            F.coalesce(read_only, F.lit(False)).alias("read_only"),
            pos.cast("bigint").alias("pos"),
        )

    home = F.filter(
        F.array(mount("home", F.col("home"), home_path, F.lit(False), F.lit(0))), lambda m: m["target"].isNotNull()
    )
    data = F.transform("data", lambda m, i: mount("data", m["target"], m["mount_path"], m["read_only"], i))
    secrets = F.transform("secrets", lambda m, i: mount("secret", m["target"], m["mount_path"], F.lit(False), i))
    empty = F.filter(home, lambda m: F.lit(False))
    every = F.concat(home, F.coalesce(data, empty), F.coalesce(secrets, empty))
    return workspaces.select("namespace", F.col("name").alias("workspace"), F.explode(every).alias("mount")).select(
        "namespace", "workspace", "mount.*"
    )


def comparable(df: DataFrame, column: str) -> Column:
    """The column in a form equality works on: maps become sorted entry arrays."""
    if isinstance(df.schema[column].dataType, T.MapType):
        return F.sort_array(F.map_entries(column))
    return F.col(column)


def changed_rows(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``current`` that are new or differ from ``previous`` in any column (exact, no hashing)."""
    others = [column for column in current.columns if column not in keys]
    before = previous.select(
        *[F.col(key).alias(f"before_{key}") for key in keys],
        *[comparable(previous, column).alias(f"before_{column}") for column in others],
    )
    same = [F.col(key) == F.col(f"before_{key}") for key in keys]
    same += [comparable(current, column).eqNullSafe(F.col(f"before_{column}")) for column in others]
    return current.join(before, reduce(Column.__and__, same), "left_anti")


def write_snapshot(current: DataFrame, previous: DataFrame, path: str, keys: list[str]) -> None:
    """Append only the changed rows."""
    changed_rows(current, previous, keys).write.mode("append").parquet(path)
