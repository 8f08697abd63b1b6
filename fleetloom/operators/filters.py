"""Row filters over the fleet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.labels import has_label


def by_kind(
    df: DataFrame, kind: str, namespace: str | None = None, image: str | None = None, pod: str | None = None
) -> DataFrame:
    """Exact match; a null argument means any."""
    for column, value in (("kind", kind), ("namespace", namespace), ("image_id", image), ("pod_id", pod)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def visible(df: DataFrame, show_hidden: bool, show_redirected: bool) -> DataFrame:
    if not show_hidden:
        df = df.filter(~F.coalesce("hidden", F.lit(False)))
    if not show_redirected:
        df = df.filter(F.col("redirect").isNull())
    return df


def is_running() -> Column:
    return F.coalesce(F.col("state") == "Running", F.lit(False))


def is_idle() -> Column:
    """Idle means any state but Running; activity plays no part."""
    return ~is_running()


def has_gpu(labels: Column) -> Column:
    """The label counts even when its value is ``"0"``."""
    return has_label(labels, "gpu")


def relevant_event(df: DataFrame) -> DataFrame:
    """Warnings about pods and sets that were created or updated."""
    return df.filter(
        (F.col("type") == "Warning")
        & F.col("involved_kind").isin("Pod", "StatefulSet")
        & F.col("change_op").isin("create", "update")
    )


def owned_by_workspace(df: DataFrame, group: str, kind: str = "Workspace") -> DataFrame:
    """The owner's API group and kind must match; its version does not matter."""
    parts = F.split("owner_api", "/")
    owner_group = F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit(""))
    return df.filter((owner_group == group) & (F.col("owner_kind") == kind))
