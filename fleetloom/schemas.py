"""Explicit schemas of the fleet tables; nothing is inferred.

Columns ending in ``_ms`` are epoch milliseconds, 0 meaning unknown.
"""

from __future__ import annotations

_CONDITIONS = (
    "ARRAY<STRUCT<source STRING, match_labels MAP<STRING,STRING>, "
    "match_exprs ARRAY<STRUCT<key STRING, op STRING, `values` ARRAY<STRING>>>>>"
)
_ASSET_REF = "STRUCT<url STRING, namespace STRING, name STRING, key STRING>"

SCHEMAS: dict[str, str] = {
    "namespaces": "name STRING, labels MAP<STRING,STRING>",
    "kinds": (
        "name STRING, display_name STRING, description STRING, hidden BOOLEAN, deprecated BOOLEAN, "
        "default_image STRING, default_pod STRING, home_path STRING, "
        "probe STRUCT<min_interval_s INT, interval_s INT, timeout_s INT>, "
        "ports ARRAY<STRUCT<id STRING, protocol STRING, default_display_name STRING, remove_prefix BOOLEAN>>, "
        "extra_volumes ARRAY<STRING>, extra_mounts ARRAY<STRUCT<name STRING, mount_path STRING>>, "
        f"scheduler STRING, icon {_ASSET_REF}, logo {_ASSET_REF}, "
        "labels MAP<STRING,STRING>, annotations MAP<STRING,STRING>"
    ),
    "options": (
        "kind STRING, option_type STRING, pos BIGINT, id STRING, display_name STRING, description STRING, "
        "labels ARRAY<STRUCT<key STRING, value STRING>>, hidden BOOLEAN, "
        "redirect STRUCT<to STRING, level STRING, text STRING>, "
        "ports ARRAY<STRUCT<id STRING, port INT, display_name STRING>>, "
        "env ARRAY<STRUCT<name STRING, value STRING>>, scheduler STRING, pull_policy STRING, "
        "resources STRUCT<requests MAP<STRING,STRING>, limits MAP<STRING,STRING>>, spec_hash STRING"
    ),
    "filter_rules": (
        "kind STRING, rule_idx INT, scope STRING, ui_hide BOOLEAN, api_hide BOOLEAN, deny BOOLEAN, "
        f"deny_message STRING, conditions {_CONDITIONS}"
    ),
    "activity_rules": (
        "kind STRING, rule_idx INT, seconds_since_active INT, min_running_seconds INT, pause BOOLEAN, "
        f"conditions {_CONDITIONS}"
    ),
    "workspaces": (
        "namespace STRING, name STRING, uid STRING, generation BIGINT, display_name STRING, kind STRING, "
        "paused BOOLEAN, image_id STRING, pod_id STRING, state STRING, state_message STRING, "
        "last_running_ms BIGINT, pause_ms BIGINT, last_activity_ms BIGINT, last_update_ms BIGINT, "
        "eligible_after_ms BIGINT, pod_name STRING, pod_uid STRING, set_uid STRING, "
        "annotations MAP<STRING,STRING>"
    ),
    "mounts": (
        "namespace STRING, workspace STRING, source STRING, target STRING, mount_path STRING, "
        "read_only BOOLEAN, pos BIGINT"
    ),
    "sets": (
        "namespace STRING, name STRING, uid STRING, owner STRING, owner_uid STRING, generation BIGINT, "
        "observed_generation BIGINT, update_revision STRING"
    ),
    "pods": (
        "namespace STRING, name STRING, uid STRING, owner_uid STRING, revision STRING, node STRING, "
        "phase STRING, deleting BOOLEAN, labels MAP<STRING,STRING>, claims ARRAY<STRING>, "
        "conditions ARRAY<STRUCT<type STRING, status STRING, reason STRING, message STRING>>, "
        "containers ARRAY<STRUCT<name STRING, init BOOLEAN, waiting_reason STRING, waiting_message STRING, "
        "has_previous BOOLEAN, requests MAP<STRING,STRING>, limits MAP<STRING,STRING>>>"
    ),
    "pvcs": (
        "namespace STRING, name STRING, volume STRING, storage_class STRING, size STRING, "
        "access_modes ARRAY<STRING>, labels MAP<STRING,STRING>"
    ),
    "pvs": "name STRING, uid STRING, reclaim STRING, mode STRING",
    "storage_classes": "name STRING, uid STRING, labels MAP<STRING,STRING>, annotations MAP<STRING,STRING>",
    "secret_meta": (
        "namespace STRING, name STRING, labels MAP<STRING,STRING>, annotations MAP<STRING,STRING>"
    ),
    "object_events": (
        "event_id BIGINT, namespace STRING, involved_kind STRING, involved_uid STRING, type STRING, "
        "reason STRING, message STRING, last_ts TIMESTAMP, change_op STRING"
    ),
    "probes": (
        "namespace STRING, workspace STRING, start_ms BIGINT, end_ms BIGINT, result STRING, "
        "message STRING, output STRING"
    ),
    "state_history": (
        "namespace STRING, workspace STRING, ts_ms BIGINT, seq BIGINT, state STRING, paused BOOLEAN"
    ),
    "usage_samples": (
        "namespace STRING, pod STRING, container STRING, ts TIMESTAMP, cpu STRING, memory STRING"
    ),
    "usage_reports": (
        "namespace STRING, pod STRING, ts TIMESTAMP, "
        "containers ARRAY<STRUCT<name STRING, cpu STRING, memory STRING>>"
    ),
    "log_lines": (
        "namespace STRING, workspace STRING, container STRING, previous BOOLEAN, ts TIMESTAMP, "
        "seq BIGINT, line STRING"
    ),
    "assets": "namespace STRING, name STRING, key STRING, content BINARY, labels MAP<STRING,STRING>",
    "owned_objects": (
        "side STRING, namespace STRING, owner STRING, role STRING, name STRING, subjects ARRAY<STRING>, "
        "labels MAP<STRING,STRING>, annotations MAP<STRING,STRING>, owned_keys ARRAY<STRING>"
    ),
    "requests": (
        "request_id STRING, op STRING, namespace STRING, name STRING, kind STRING, image_id STRING, "
        "pod_id STRING, revision STRING"
    ),
}
