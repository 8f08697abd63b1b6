"""Fixed values shared by the operators. Label keys carry a neutral prefix; pass your own keys to the operators."""

from __future__ import annotations

# Permission and ownership label keys (parameters of the operators that read them).
CAN_MOUNT = "fleet/can-mount"
CAN_UPDATE = "fleet/can-update"
CAN_USE = "fleet/can-use"
WORKSPACE_LABEL = "fleet/workspace-name"
IMAGE_SOURCE_LABEL = "fleet/image-source"

# Audit annotation keys.
CREATED_BY = "fleet/created-by"
UPDATED_BY = "fleet/updated-by"
UPDATED_AT = "fleet/updated-at"

# Sentinels for unknown references.
UNKNOWN_IMAGE = "__UNKNOWN_IMAGE_CONFIG__"
UNKNOWN_POD = "__UNKNOWN_POD_CONFIG__"
UNKNOWN_HOME = "__UNKNOWN_HOME_MOUNT_PATH__"

# Rule scopes.
SCOPE_KIND = "WORKSPACE_KIND"
SCOPE_IMAGE = "IMAGE_CONFIG"
SCOPE_POD = "POD_CONFIG"

# Probe interval defaults in seconds.
PROBE_INTERVAL_S = 3600
PROBE_MIN_INTERVAL_S = 300

# Activity thresholds in milliseconds.
CRITICAL_MS = 5 * 60 * 1000
WARNING_MS = 15 * 60 * 1000

# Log defaults.
LOG_TAIL_LINES = 1000
LOG_BYTE_CAP = 100 * 1024 * 1024
MAIN_CONTAINER = "main"

# Error codes of stored images.
ASSET_MISSING = "CONFIGMAP_MISSING"
ASSET_KEY_MISSING = "CONFIGMAP_KEY_MISSING"
ASSET_OTHER = "CONFIGMAP_OTHER"
ASSET_UNKNOWN = "CONFIGMAP_UNKNOWN"
