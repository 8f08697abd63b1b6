"""Ordered look-backs that never gather a whole key in one task.

Rows are dealt by ranges of (keys, order), so the number of rows bounds a task, whatever the clock says. What a range has
to tell the next ones is one row for each key in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.functions.columns import join_null_safe
from fleetloom.session import cut_lineage


def in_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` in ranges of (keys, order), numbered upwards by ``_range``; nulls come first.

    It is written once, because ranges that are found anew after a lost executor would differ.
    """
    return cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))


def sum_beside(per_range: DataFrame, keys: list[str], value: str, name: str, later: bool = False) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the key's earlier (or later) ranges."""
    place = F.col("_range").desc() if later else F.col("_range").asc()
    others = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return per_range.withColumn(name, F.coalesce(F.sum(value).over(others), F.lit(0).cast("bigint")))


def previous_in(dealt: DataFrame, keys: list[str], order: list[str], values: list[str], name: str = "prev") -> DataFrame:
    """:func:`with_previous` of a table from :func:`in_ranges`."""
    packed = F.struct(*values)
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_range")
    carried = (
        dealt.groupBy(*keys, "_range")
        .agg(F.max_by(packed, F.struct(*order)).alias("_last"))
        .select(*keys, "_range", F.lag("_last").over(across).alias("_carry"))
    )
    return (
        join_null_safe(dealt.withColumn("_prev", F.lag(packed).over(inside)), carried, [*keys, "_range"], "left")
        .withColumn(name, F.coalesce("_prev", "_carry"))
        .drop("_prev", "_carry", "_range")
    )


def with_previous(df: DataFrame, keys: list[str], order: list[str], values: list[str], name: str = "prev") -> DataFrame:
    """Add ``name``: the struct of ``values`` of the key's preceding row, null for its first row.

    A segmented scan: rows are windowed inside their range, and the last row of each key in a range, found by a partial
    aggregate, is handed to the key's next range. A key that holds a third of all rows is spread over a third of the
    ranges, even if all its rows have one time and differ in a later column of ``order`` only. Null keys and times are
    values like any other: no row is lost.
    """
    return previous_in(in_ranges(df, keys, order), keys, order, values, name)
