"""Violation rows from one pass over a table."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violation(condition: Column, **fields: Column | str) -> Column:
    """A struct of the fields where the condition holds, else null."""
    columns = [
        (F.lit(value) if isinstance(value, str) else value).alias(name) for name, value in fields.items()
    ]
    return F.when(condition, F.struct(*columns))


def report(df: DataFrame, keys: list[str], violations: list[Column]) -> DataFrame:
    """Every violation of every row, as one row each: a single scan, no union of filtered copies.

    Nulls are dropped after the explode: compacting the array first would evaluate every check uncompiled.
    """
    found = df.select(*keys, F.explode(F.array(*violations)).alias("v")).filter(F.col("v").isNotNull())
    return found.select(*keys, "v.*")


def coded_report(df: DataFrame, keys: list[str], findings: list[tuple[str | None, str, Column]]) -> DataFrame:
    """One row per finding (field, code, condition) that holds, with the keys; a null condition does not hold.

    Findings are bits of one number per row, exploded as numbers and named after the rest is dropped. The number
    itself is not filtered on: that filter would be pushed below the parsing steps and repeat them in each condition.
    Without any field the column is left out.
    """
    bits = [F.when(condition, F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, _, condition) in enumerate(findings)]
    marked = df.select(*keys, functools.reduce(lambda a, b: a.bitwiseOR(b), bits).alias("_mask"))
    each = [F.when(F.col("_mask").bitwiseAND(1 << i) != 0, F.lit(i)) for i in range(len(findings))]
    found = marked.select(*keys, F.explode(F.array(*each)).alias("_i")).filter(F.col("_i").isNotNull())

    def named(values: list[str]) -> Column:
        return F.get(F.array(*[F.lit(value) for value in values]), F.col("_i"))

    codes = named([code for _, code, _ in findings]).alias("code")
    if findings[0][0] is None:
        return found.select(*keys, codes)
    return found.select(*keys, named([field for field, _, _ in findings]).alias("field"), codes)
