"""Sorting, paging and stable order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetloom.session import cut_lineage, forget


def _sort_key(df: DataFrame, column: str, collation: str | None) -> Column:
    if collation and isinstance(df.schema[column].dataType, T.StringType):
        return F.collate(F.col(column), collation)
    return F.col(column)


def row_order(
    df: DataFrame,
    column: str = "last_activity_ms",
    descending: bool = True,
    keys: tuple[str, ...] = ("namespace", "name"),
    collation: str | None = "UNICODE",
) -> list[Column]:
    """Numbers by value, text in locale order, nulls last; a unique key breaks ties."""
    key = _sort_key(df, column, collation)
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), *[F.col(k).asc() for k in keys]]


def sort_workspaces(
    df: DataFrame,
    column: str = "last_activity_ms",
    descending: bool = True,
    keys: tuple[str, ...] = ("namespace", "name"),
    collation: str | None = "UNICODE",
) -> DataFrame:
    """``df`` in the order of :func:`row_order`."""
    return df.orderBy(*row_order(df, column, descending, keys, collation))


def sort_kinds(df: DataFrame, column: str, descending: bool = False, collation: str | None = "UNICODE") -> DataFrame:
    return sort_workspaces(df, column, descending, ("name",), collation)


def page(df: DataFrame, order: list[Column], number: int, size: int = 10) -> DataFrame:
    """One page (from 1) of ``df`` in ``order``; numbers outside are clamped to the first or last page.

    ``df`` is computed once and dealt by ranges of the order, unsorted. The number of rows in each range, one number per
    range, tells which ranges the page lies in; only these are sorted. So a page costs the same at every depth, and no
    task holds the rows before it. ``order`` must be unique, or the place of equal rows is open.
    """
    whole = cut_lineage(df)
    dealt = cut_lineage(whole.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    forget(whole)
    sizes = dict(dealt.groupBy("_range").count().collect())
    total = sum(sizes.values())
    start = (min(max(1, number), max(1, -(-total // size))) - 1) * size
    chosen, before, skipped = [], 0, 0
    for part in sorted(sizes):
        if before + sizes[part] <= start:
            skipped += sizes[part]
        elif before < start + size:
            chosen.append(part)
        before += sizes[part]
    rows = dealt.filter(F.col("_range").isin(chosen)).orderBy("_range", *order)
    return rows.offset(start - skipped).limit(size).drop("_range")


def stable_order(previous: DataFrame, current: DataFrame, sort_key: str, resort: bool = False) -> DataFrame:
    """Keep the previous order of ids still present, then append new ids in sort order.

    ``order_key`` is a struct that sorts the result; no global row number is computed.
    """
    rank = F.lit(None).cast("bigint") if resort else F.col("prev_rank")
    return (
        current.join(previous.select("id", "prev_rank"), "id", "left")
        .withColumn("is_new", rank.isNull())
        .withColumn("prev_rank", rank)
        .withColumn("order_key", F.struct("is_new", "prev_rank", sort_key, "id"))
    )


def persist_rank(ordered: DataFrame) -> DataFrame:
    """Ids of an ordered table with an increasing (not contiguous) rank to keep as the next previous order."""
    return ordered.select("id", F.monotonically_increasing_id().alias("prev_rank"))
