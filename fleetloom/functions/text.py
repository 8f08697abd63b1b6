"""Toolbar-style text and multi-select filters."""

from __future__ import annotations

from functools import lru_cache

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=1024)
def search_pattern(pattern: str) -> str:
    """Case-insensitive regex; text that the JVM's engine, which searches, cannot compile is searched literally.

    Each distinct pattern is compiled once, by the driver's JVM.
    """
    engine = SparkContext._active_spark_context._jvm.java.util.regex.Pattern
    try:
        engine.compile(f"(?iu){pattern}")
    except (Py4JJavaError, IllegalArgumentException):
        pattern = engine.quote(pattern)
    return f"(?iu){pattern}"


def text_filter(df: DataFrame, patterns: dict[str, str], getters: dict[str, Column] | None = None) -> DataFrame:
    """Keep rows whose columns all contain a match; an empty pattern is inactive, white space is active."""
    getters = getters or {}
    for name, pattern in patterns.items():
        if pattern != "":
            df = df.filter(F.coalesce(getters.get(name, F.col(name)), F.lit("")).rlike(search_pattern(pattern)))
    return df


def multiselect(df: DataFrame, selected: dict[str, list[str]], getters: dict[str, Column] | None = None) -> DataFrame:
    """Case-insensitive membership: any value of a filter, all filters; an empty list is inactive."""
    getters = getters or {}
    for name, values in selected.items():
        if values:
            lowered = sorted({value.lower() for value in values})
            df = df.filter(F.lower(getters.get(name, F.col(name))).isin(lowered))
    return df


def facet_filter(df: DataFrame, selected: dict[str, set[str]], labels: str = "labels") -> DataFrame:
    """Any selected value of a key, all keys; empty sets are ignored."""

    def carries(key: str, values: set[str]) -> Column:
        found = F.exists(F.col(labels), lambda entry: (entry["key"] == key) & entry["value"].isin(sorted(values)))
        return F.coalesce(found, F.lit(False))

    for key, values in selected.items():
        if values:
            df = df.filter(carries(key, values))
    return df
