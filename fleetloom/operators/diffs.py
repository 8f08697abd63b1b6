"""Desired against observed state, and old against new."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.labels import empty_labels

OBJECT_KEY = ["namespace", "owner", "role"]


def first_by_name(objects: DataFrame, keys: list[str]) -> DataFrame:
    """The first object (by name) of each key: a partial aggregate, so a crowded key stays small."""
    others = [column for column in objects.columns if column not in keys]
    return (
        objects.groupBy(*keys)
        .agg(F.min_by(F.struct(*others), "name").alias("o"))
        .select(*keys, *[F.col(f"o.{column}").alias(column) for column in others])
    )


def pair_objects(desired: DataFrame, observed: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Desired and observed object of each key as the structs ``d`` and ``o``."""

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))

    return packed(desired, "d").join(packed(observed, "o"), keys, how)


def _map_drift(desired: Column, observed: Column) -> Column:
    """Keys whose values differ; a missing key compares as the empty string."""
    desired, observed = F.coalesce(desired, empty_labels()), F.coalesce(observed, empty_labels())
    blank = F.lit("")
    keys = F.array_union(F.map_keys(desired), F.map_keys(observed))
    return F.filter(
        keys,
        lambda key: F.coalesce(F.try_element_at(desired, key), blank)
        != F.coalesce(F.try_element_at(observed, key), blank),
    )


def fields_differ(maps: list[str], fields: list[str]) -> Column:
    """True when any map or plain field of the pair ``d``, ``o`` differs."""
    parts = [F.size(_map_drift(F.col(f"d.{name}"), F.col(f"o.{name}"))) > 0 for name in maps]
    parts += [~F.col(f"d.{name}").eqNullSafe(F.col(f"o.{name}")) for name in fields]
    return reduce(Column.__or__, parts)


def reconcile_plan(
    desired: DataFrame, observed: DataFrame, maps: list[str], fields: list[str], keys: list[str] | None = None
) -> DataFrame:
    """What to do per object: create, update, keep or delete.

    Of several observed objects of one wanted key the first is kept and the others are deleted.
    """
    keys = keys or OBJECT_KEY
    wanted = first_by_name(desired, keys)
    found = first_by_name(observed, keys)
    paired = pair_objects(wanted, found, keys, "full_outer")
    action = (
        F.when(F.col("o").isNull(), F.lit("create"))
        .when(F.col("d").isNull(), F.lit("delete"))
        .when(fields_differ(maps, fields), F.lit("update"))
        .otherwise(F.lit("keep"))
    )
    planned = paired.select(*keys, F.coalesce("o.name", "d.name").alias("name"), action.alias("action"))
    first_names = found.select(*keys, F.col("name").alias("first_name"))
    surplus = observed.select(*keys, "name").join(first_names, keys).filter(F.col("name") != F.col("first_name"))
    return planned.unionByName(surplus.select(*keys, "name", F.lit("delete").alias("action")))


def map_drift_replace(desired: DataFrame, observed: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Per object and map key that differs in either direction: the wanted and the found value."""
    keys = keys or OBJECT_KEY
    pairs = pair_objects(desired, observed, keys)
    drift = _map_drift(F.col(f"d.{name}"), F.col(f"o.{name}"))
    return pairs.select(*keys, "d", "o", F.explode(drift).alias("key")).select(
        *keys,
        "key",
        F.try_element_at(F.col(f"d.{name}"), F.col("key")).alias("desired"),
        F.try_element_at(F.col(f"o.{name}"), F.col("key")).alias("observed"),
    )


def map_drift_merge(desired: DataFrame, observed: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Per object and map key: add, change, keep, or remove (only keys listed in ``owned_keys``)."""
    keys = keys or OBJECT_KEY
    want, have = F.coalesce(F.col(f"d.{name}"), empty_labels()), F.coalesce(F.col(f"o.{name}"), empty_labels())
    every = F.array_union(F.map_keys(want), F.map_keys(have))
    key = F.col("key")
    wanted, found = F.try_element_at(F.col("want"), key), F.try_element_at(F.col("have"), key)
    blank = F.lit("")
    action = (
        F.when(wanted.isNull() & F.coalesce(F.array_contains("owned", key), F.lit(False)), F.lit("remove"))
        .when(wanted.isNull(), F.lit("keep"))
        .when(wanted == F.coalesce(found, blank), F.lit("keep"))
        .when(found.isNull(), F.lit("add"))
        .otherwise(F.lit("change"))
    )
    return (
        pair_objects(desired, observed, keys)
        .select(
            *keys,
            want.alias("want"),
            have.alias("have"),
            F.col("o.owned_keys").alias("owned"),
            F.explode(every).alias("key"),
        )
        .select(*keys, "key", action.alias("action"))
    )


def field_drift(
    desired: DataFrame, observed: DataFrame, maps: list[str], fields: list[str], keys: list[str] | None = None
) -> DataFrame:
    """The names of the fields that differ, one row per object and field."""
    keys = keys or OBJECT_KEY
    pairs = pair_objects(desired, observed, keys)
    differs = [
        F.when(F.size(_map_drift(F.col(f"d.{name}"), F.col(f"o.{name}"))) > 0, F.lit(name)) for name in maps
    ] + [F.when(~F.col(f"d.{name}").eqNullSafe(F.col(f"o.{name}")), F.lit(name)) for name in fields]
    return pairs.select(*keys, F.explode(F.array_compact(F.array(*differs))).alias("field"))


def readopt(objects: DataFrame, workspaces: DataFrame, api_version: str, kind: str = "Workspace") -> DataFrame:
    """Owned objects to re-adopt (stale owner uid or API version), and those another kind of owner holds.

    The owner's API group and kind decide whether the owner is a workspace; its version does not.
    """
    current = workspaces.select("namespace", F.col("name").alias("owner"), F.col("uid").alias("current_uid"))
    same_group = F.split("owner_api", "/")[0] == api_version.split("/")[0]
    held = (F.col("owner_uid") == F.col("current_uid")) & (F.col("owner_api") == api_version)
    action = F.when(held, F.lit(None)).when(same_group & (F.col("owner_kind") == kind), F.lit("adopt")).otherwise(
        F.lit("error")
    )
    return (
        objects.join(current, ["namespace", "owner"])
        .select("namespace", "owner", "name", "owner_kind", action.alias("action"))
        .filter(F.col("action").isNotNull())
    )


def option_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """added, removed, changed or kept per option, with the checks that must be repeated.

    Both sides hold kind, option_type, id, spec_hash and redirect.
    """
    keys = ["kind", "option_type", "id"]
    paired = pair_objects(new.select(*keys, "spec_hash", "redirect"), old.select(*keys, "spec_hash", "redirect"), keys, "full_outer")
    status = (
        F.when(F.col("o").isNull(), F.lit("added"))
        .when(F.col("d").isNull(), F.lit("removed"))
        .when(~F.col("d.spec_hash").eqNullSafe(F.col("o.spec_hash")), F.lit("changed"))
        .otherwise(F.lit("kept"))
    )
    redirect_changed = (
        F.col("o").isNull() | F.col("d").isNull() | ~F.col("d.redirect").eqNullSafe(F.col("o.redirect"))
    )
    return paired.select(
        *keys,
        status.alias("status"),
        status.isin("added", "changed").alias("recheck_value"),
        redirect_changed.alias("recheck_redirects"),
    )


def redirect_rechecks(changes: DataFrame) -> DataFrame:
    """(kind, option_type) whose redirects must be checked again."""
    return changes.filter("recheck_redirects").select("kind", "option_type").distinct()


def option_change_audit(old: DataFrame, new: DataFrame, usage: DataFrame) -> DataFrame:
    """Options in use that were changed or removed: both are refused."""
    used = usage.filter(F.col("workspaces") > 0).select("kind", "option_type", "id", "workspaces")
    bad = option_changes(old, new).filter(F.col("status").isin("changed", "removed"))
    message = F.format_string('%sConfig value "%s" is in use and cannot be %s', "option_type", "id", "status")
    return bad.join(used, ["kind", "option_type", "id"]).select(
        "kind", "option_type", "id", "status", "workspaces", message.alias("message")
    )


def membership_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """removed, added or kept per (owner, name) in either list."""
    keys = ["owner", "name"]
    before = old.select(*keys).distinct().withColumn("before", F.lit(True))
    after = new.select(*keys).distinct().withColumn("after", F.lit(True))
    status = (
        F.when(F.col("after").isNull(), F.lit("removed")).when(F.col("before").isNull(), F.lit("added")).otherwise(F.lit("kept"))
    )
    return before.join(after, keys, "full_outer").select(*keys, status.alias("status"))

