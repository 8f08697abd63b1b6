"""Container log text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.functions.columns import parse_rfc3339

CONTAINER = ["namespace", "workspace", "container"]


def parse_log_lines(df: DataFrame) -> DataFrame:
    """Split ``value`` into its leading timestamp and the text; lines without one keep the whole text."""
    others = [column for column in df.columns if column != "value"]
    # a projection for each step, so that nothing is taken from a line twice
    told = df.withColumn("_first_word", F.substring_index("value", " ", 1))
    told = told.withColumn("_told_ts", parse_rfc3339(F.col("_first_word")))
    rest = F.expr("if(_told_ts is null, value, substring(value, length(_first_word) + 2))")
    return told.select(*others, F.col("_told_ts").alias("ts"), rest.alias("line"))


def prefixed(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``value`` with the ``keys`` before it, ``[ws-1/main] text``, as a collector writes the lines of many containers
    to one file. A null key is empty, a null ``value`` too; the names themselves hold no slash, blank or bracket."""
    told = F.concat_ws("/", *[F.coalesce(F.col(key), F.lit("")) for key in keys])
    value = F.concat(F.lit("["), told, F.lit("] "), F.coalesce("value", F.lit("")))
    return lines.withColumn("value", value).drop(*keys)


def unprefixed(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The ``keys`` that :func:`prefixed` put before ``value``; lines without them keep the whole text, keys are null."""
    if not keys:
        return lines
    others = [column for column in lines.columns if column != "value"]
    pattern = r"^\[" + "/".join([r"[^/\]]*"] * len(keys)) + r"\]\z"
    told = lines.withColumn("_told", F.substring_index("value", " ", 1))
    there = F.col("_told").rlike(pattern) & (F.length("_told") < F.length("value"))
    names = F.split(F.expr("substring(_told, 2, length(_told) - 2)"), "/")
    told = told.withColumn("_names", F.when(there, names))
    found = [F.nullif(F.get("_names", F.lit(n)), F.lit("")).alias(key) for n, key in enumerate(keys)]
    rest = F.expr("if(_names is null, value, substring(value, length(_told) + 2))").alias("value")
    return told.select(*others, *found, rest)


def _lines(reader, path: str, folders: list[str]) -> DataFrame:
    schema = ", ".join(f"{name} STRING" for name in [*folders, "value"])
    lines = reader.schema(schema).option("basePath", path).text(path)
    keyed = unprefixed(lines, [key for key in CONTAINER if key not in folders])
    return parse_log_lines(keyed).select(*CONTAINER, "ts", "line")


def read_logs(spark: SparkSession, path: str, folders: list[str] = CONTAINER) -> DataFrame:
    """Text files under ``namespace=…/workspace=…/container=…`` folders.

    With fewer ``folders`` the other keys stand before each line (:func:`prefixed`): a folder for each container is a
    file at least for each, which a large fleet's logs should not be.
    """
    return _lines(spark.read, path, folders)


def stream_logs(spark: SparkSession, path: str, folders: list[str] = CONTAINER) -> DataFrame:
    return _lines(spark.readStream, path, folders)
