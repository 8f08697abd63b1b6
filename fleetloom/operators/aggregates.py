"""Usage counts, GPU totals, facets and other aggregates.

Every aggregate is a partial (map-side) aggregate, so a kind holding a third of the fleet shrinks to one row per
task before it is shuffled. Member lists are returned as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.constants import CAN_MOUNT
from fleetloom.functions.labels import first_label, label_is_true
from fleetloom.functions.quantities import gpu_count
from fleetloom.operators.filters import has_gpu, is_idle, is_running


def selected_options(workspaces: DataFrame) -> DataFrame:
    """(kind, option_type, id) of both selected options of every workspace, from one scan."""
    pair = F.array(
        F.struct(F.lit("image").alias("option_type"), F.col("image_id").alias("id")),
        F.struct(F.lit("pod").alias("option_type"), F.col("pod_id").alias("id")),
    )
    return workspaces.select("kind", F.explode(pair).alias("o")).select("kind", "o.option_type", "o.id")


def option_usage(workspaces: DataFrame, options: DataFrame) -> DataFrame:
    """Workspaces per option, zero-filled; ids the kind does not define are dropped."""
    counts = selected_options(workspaces).groupBy("kind", "option_type", "id").agg(F.count("*").alias("workspaces"))
    return (
        options.select("kind", "option_type", "id")
        .join(counts, ["kind", "option_type", "id"], "left")
        .withColumn("workspaces", F.coalesce("workspaces", F.lit(0).cast("bigint")))
    )


def kind_usage(workspaces: DataFrame, kinds: DataFrame) -> DataFrame:
    counts = workspaces.groupBy("kind").agg(F.count("*").alias("workspaces"))
    return (
        kinds.select(F.col("name").alias("kind"))
        .join(counts, "kind", "left")
        .withColumn("workspaces", F.coalesce("workspaces", F.lit(0).cast("bigint")))
    )


def kind_namespace_usage(workspaces: DataFrame, kinds: DataFrame) -> DataFrame:
    """Workspaces per kind and namespace, no zero rows; counted before the kinds are looked up."""
    counts = workspaces.groupBy("kind", "namespace").agg(F.count("*").alias("workspaces"))
    return counts.join(kinds.select(F.col("name").alias("kind")), "kind", "left_semi")


def usage_summary(workspaces: DataFrame, kinds: DataFrame, options: DataFrame) -> DataFrame:
    """Total and the counts by image, pod config and namespace, as (kind, dimension, key, workspaces) rows."""
    total = kind_usage(workspaces, kinds).select(
        "kind", F.lit("total").alias("dimension"), F.lit("").alias("key"), "workspaces"
    )
    by_option = option_usage(workspaces, options).select(
        "kind", F.col("option_type").alias("dimension"), F.col("id").alias("key"), "workspaces"
    )
    by_namespace = kind_namespace_usage(workspaces, kinds).select(
        "kind", F.lit("namespace").alias("dimension"), F.col("namespace").alias("key"), "workspaces"
    )
    return total.unionByName(by_option).unionByName(by_namespace)


def unused_kinds(kinds: DataFrame, workspaces: DataFrame) -> DataFrame:
    return kinds.join(workspaces.select(F.col("kind").alias("name")).distinct(), "name", "left_anti")


def gpus(labels: Column) -> Column:
    return gpu_count(first_label(labels, "gpu"))


def gpu_totals(workspaces: DataFrame, labels: Column) -> DataFrame:
    """GPUs in use (running workspaces) and requested (all)."""
    count = gpus(labels)
    zero = F.lit(0.0)
    return workspaces.agg(
        F.coalesce(F.sum(F.when(is_running(), count)), zero).alias("in_use"),
        F.coalesce(F.sum(count), zero).alias("requested"),
    )


def gpu_by_namespace(workspaces: DataFrame, labels: Column) -> DataFrame:
    return workspaces.groupBy("namespace").agg(F.sum(gpus(labels)).alias("gpus"), F.count("*").alias("members"))


def gpu_members(workspaces: DataFrame, labels: Column) -> DataFrame:
    """The workspaces behind each namespace total, one row each."""
    return workspaces.select("namespace", "name", gpus(labels).alias("gpus"))


def order_by_gpus(totals: DataFrame, descending: bool = True) -> DataFrame:
    return totals.orderBy(F.desc("gpus") if descending else F.asc("gpus"), "namespace")


def top_gpu_namespaces(workspaces: DataFrame, labels: Column, k: int = 2) -> DataFrame:
    return order_by_gpus(gpu_by_namespace(workspaces, labels).filter(F.col("gpus") > 0)).limit(k)


def idle_gpu_count(workspaces: DataFrame, labels: Column) -> DataFrame:
    return workspaces.agg(F.count_if(is_idle() & has_gpu(labels)).alias("idle_with_gpu"))


def facets(df: DataFrame) -> DataFrame:
    """Distinct (key, value) pairs of the label arrays."""
    return df.select(F.explode("labels").alias("l")).select("l.key", "l.value").distinct()


def facet_availability(df: DataFrame, extra: Column) -> DataFrame:
    """All facet values with a flag telling whether rows passing the extra filters still carry them."""
    kept = F.coalesce(extra, F.lit(False))
    return (
        df.select(kept.alias("kept"), F.explode("labels").alias("l"))
        .groupBy("l.key", "l.value")
        .agg(F.max("kept").alias("available"))
    )


def selectable_facets(selected: DataFrame, availability: DataFrame) -> DataFrame:
    """Selected (key, value) rows without those the extra filters made unavailable."""
    return selected.join(availability.filter("available"), ["key", "value"], "left_semi")


def last_warning(events: DataFrame) -> DataFrame:
    """Most recent warning per (namespace, uid); ties go to the smallest event id.

    ``max_by`` aggregates partially, so one crashing pod that owns most events costs one row per task.
    """
    newest = F.max_by(F.struct("event_id", "reason", "message", "last_ts"), F.struct("last_ts", -F.col("event_id")))
    return (
        events.filter((F.col("type") == "Warning") & (F.col("involved_uid") != ""))
        .groupBy("namespace", F.col("involved_uid").alias("uid"))
        .agg(newest.alias("w"), F.count("*").alias("warnings"))
        .select("namespace", "uid", "warnings", "w.*")
    )


def multi_owned(objects: DataFrame) -> DataFrame:
    """Every object of an (owner, role) that owns more than one, with the count; one row per object."""
    counts = objects.groupBy("namespace", "owner", "role").agg(F.count("*").alias("owned")).filter("owned > 1")
    return objects.select("namespace", "owner", "role", "name").join(counts, ["namespace", "owner", "role"])


def pvc_by_class(pvcs: DataFrame, storage_classes: DataFrame, blocked: Column | None = None) -> DataFrame:
    """Claims with their class group (empty is ``default``), its display name and whether they are disabled.

    Order by (group, disabled, name) to list usable claims first.
    """
    classes = storage_classes.select(
        F.col("name").alias("group"), F.try_element_at("annotations", F.lit("display-name")).alias("shown")
    )
    disabled = ~label_is_true(F.col("labels"), CAN_MOUNT)
    if blocked is not None:
        disabled = disabled | F.coalesce(blocked, F.lit(False))
    named = F.coalesce(F.when(F.col("storage_class") == "", F.lit(None)).otherwise(F.col("storage_class")), F.lit("default"))
    return (
        pvcs.withColumn("group", named)
        .join(classes, "group", "left")
        .select(
            "namespace",
            "name",
            "group",
            F.coalesce("shown", "group").alias("group_display_name"),
            disabled.alias("disabled"),
        )
    )


def resource_keys(containers: DataFrame) -> DataFrame:
    """Union of request and limit keys per container."""
    keys = F.array_union(F.map_keys("requests"), F.map_keys("limits"))
    return containers.select("namespace", "pod", "container", F.explode(keys).alias("resource"))

