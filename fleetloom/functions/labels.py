"""Label maps and label selectors as Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetloom.constants import CAN_MOUNT, CAN_UPDATE, CAN_USE

# Syntax of label keys and values.
LABEL_NAME_PATTERN = "^([A-Za-z0-9][-A-Za-z0-9_.]*)?[A-Za-z0-9]$"
LABEL_PREFIX_PATTERN = r"^[a-z0-9]([-a-z0-9]*[a-z0-9])?(\.[a-z0-9]([-a-z0-9]*[a-z0-9])?)*$"


@dataclass(frozen=True)
class Requirement:
    """One match expression: ``op`` is In, NotIn, Exists or DoesNotExist."""

    key: str
    op: str
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Selector:
    """A label selector; an empty selector matches everything."""

    match_labels: dict[str, str] = field(default_factory=dict)
    match_exprs: tuple[Requirement, ...] = ()


def empty_labels() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def labels_map(labels: Column) -> Column:
    """Array of (key, value) to a map; the last duplicate wins; never null."""
    entries = F.coalesce(labels, F.array().cast("array<struct<key:string,value:string>>"))
    count = F.size(entries)
    last = F.filter(
        entries,
        lambda entry, i: ~F.exists(
            F.slice(entries, i + 2, F.greatest(count - i - 1, F.lit(0))), lambda later: later["key"] == entry["key"]
        ),
    )
    return F.map_from_entries(last)


def merge_maps(*maps: Column) -> Column:
    """Layered merge, later arguments win."""

    def overlay(below: Column, above: Column) -> Column:
        return F.map_concat(F.map_filter(below, lambda key, _value: ~F.map_contains_key(above, key)), above)

    return reduce(overlay, [F.coalesce(layer, empty_labels()) for layer in maps])


def first_label(labels: Column, key: str) -> Column:
    """Value of the first entry with this key (not the last-wins map)."""
    return F.get(F.filter(labels, lambda entry: entry["key"] == key), F.lit(0))["value"]


def has_label(labels: Column, key: str) -> Column:
    return F.coalesce(F.exists(labels, lambda entry: entry["key"] == key), F.lit(False))


def label_is_true(labels: Column, key: str) -> Column:
    """True only when the label equals exactly ``"true"``."""
    return F.coalesce(F.try_element_at(labels, F.lit(key)) == "true", F.lit(False))


def permission_cols(
    labels: Column, can_mount: str = CAN_MOUNT, can_update: str = CAN_UPDATE, can_use: str = CAN_USE
) -> list[Column]:
    return [
        label_is_true(labels, can_mount).alias("can_mount"),
        label_is_true(labels, can_update).alias("can_update"),
        label_is_true(labels, can_use).alias("can_use"),
    ]


def package_labels(labels: Column) -> Column:
    return F.filter(labels, lambda entry: entry["key"].endswith("Version"))


def _requirement_matches(labels: Column, requirement: Requirement) -> Column:
    value = F.try_element_at(labels, F.lit(requirement.key))
    present = F.coalesce(F.map_contains_key(labels, requirement.key), F.lit(False))
    listed = F.coalesce(value.isin(list(requirement.values)), F.lit(False))
    return {"In": listed, "NotIn": ~listed, "Exists": present, "DoesNotExist": ~present}[requirement.op]


def selector_matches(labels: Column, selector: Selector) -> Column:
    """Compile a known selector to a boolean Column; a null map is evaluated as an empty one."""
    matched = F.lit(True)
    for key, value in selector.match_labels.items():
        matched = matched & F.coalesce(F.try_element_at(labels, F.lit(key)) == value, F.lit(False))
    for requirement in selector.match_exprs:
        matched = matched & _requirement_matches(labels, requirement)
    return matched


def selector_matches_ctx(labels: Column, selector: Selector) -> Column:
    """Like :func:`selector_matches`, but an absent (null) map never matches."""
    return labels.isNotNull() & selector_matches(labels, selector)


def stored_selector_matches(labels: Column, match_labels: Column, match_exprs: Column) -> Column:
    """A selector held in columns; a null map is evaluated as an empty one."""

    def matches(requirement: Column) -> Column:
        value = F.try_element_at(labels, requirement["key"])
        listed = F.coalesce(F.array_contains(requirement["values"], value), F.lit(False))
        present = F.coalesce(F.array_contains(F.map_keys(labels), requirement["key"]), F.lit(False))
        return (
            F.when(requirement["op"] == "In", listed)
            .when(requirement["op"] == "NotIn", ~listed)
            .when(requirement["op"] == "Exists", present)
            .when(requirement["op"] == "DoesNotExist", ~present)
            .otherwise(F.lit(False))
        )

    labels_ok = F.forall(
        F.map_entries(match_labels),
        lambda entry: F.coalesce(F.try_element_at(labels, entry["key"]) == entry["value"], F.lit(False)),
    )
    return F.coalesce(labels_ok, F.lit(True)) & F.coalesce(F.forall(match_exprs, matches), F.lit(True))


def is_label_value(value: str) -> bool:
    """:func:`valid_label_value` of a known value."""
    return value == "" or (len(value) <= 63 and re.search(LABEL_NAME_PATTERN, value) is not None)


def is_label_key(key: str) -> bool:
    """:func:`valid_label_key` of a known key."""
    prefix, slash, name = key.rpartition("/")
    if slash and (len(prefix) > 253 or re.search(LABEL_PREFIX_PATTERN, prefix) is None):
        return False
    return name != "" and is_label_value(name)


def valid_label_key(key: Column) -> Column:
    """Optional DNS prefix of at most 253 characters, a slash, and a name of at most 63."""
    parts = F.split(key, "/")
    name = F.element_at(parts, -1)
    prefix = F.get(parts, F.lit(0))
    name_ok = name.rlike(LABEL_NAME_PATTERN) & (F.length(name) <= 63)
    prefix_ok = prefix.rlike(LABEL_PREFIX_PATTERN) & (F.length(prefix) <= 253)
    return F.when(F.size(parts) == 1, name_ok).when(F.size(parts) == 2, name_ok & prefix_ok).otherwise(F.lit(False))


def valid_label_value(value: Column) -> Column:
    return (value == "") | (value.rlike(LABEL_NAME_PATTERN) & (F.length(value) <= 63))


def stored_selector_valid(match_labels: Column, match_exprs: Column) -> Column:
    """In and NotIn need values, Exists and DoesNotExist none; keys and values follow the label syntax."""

    def valid(requirement: Column) -> Column:
        count = F.coalesce(F.size(requirement["values"]), F.lit(0))
        count = F.when(requirement["values"].isNull(), F.lit(0)).otherwise(count)
        arity = (
            F.when(requirement["op"].isin("In", "NotIn"), count > 0)
            .when(requirement["op"].isin("Exists", "DoesNotExist"), count == 0)
            .otherwise(F.lit(False))
        )
        values_ok = F.coalesce(F.forall(requirement["values"], valid_label_value), F.lit(True))
        return F.coalesce(arity & valid_label_key(requirement["key"]) & values_ok, F.lit(False))

    labels_ok = F.forall(
        F.map_entries(match_labels),
        lambda entry: valid_label_key(entry["key"]) & valid_label_value(entry["value"]),
    )
    return F.coalesce(labels_ok, F.lit(True)) & F.coalesce(F.forall(match_exprs, valid), F.lit(True))
