"""Small view columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom import constants as C
from fleetloom.functions.labels import empty_labels, merge_maps

# Fixed value: RFC 3339 date-time text.
RFC3339_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"


def parse_rfc3339(text: Column) -> Column:
    """Timestamp, or null when the text is not RFC 3339."""
    return F.when(text.rlike(RFC3339_PATTERN), F.regexp_replace(text, ",", ".").try_cast("timestamp"))


def redirect_level(level: Column) -> Column:
    """Info, Warning or Danger; anything else is Info."""
    return F.when(level.isin("Info", "Warning", "Danger"), level).otherwise(F.lit("Info"))


def display_name(name: Column, shown: Column) -> Column:
    return F.when(shown.rlike(r"\S"), shown).otherwise(name)


def normalise_state(state: Column) -> Column:
    return F.when(state.isNull() | (state == ""), F.lit("Unknown")).otherwise(state)


def pending_update(image_steps: Column, pod_steps: Column) -> Column:
    """True when either redirect chain has a step."""
    return (F.coalesce(image_steps, F.lit(0)) > 0) | (F.coalesce(pod_steps, F.lit(0)) > 0)


def revision(uid: Column, name: Column, generation: Column) -> Column:
    return F.sha2(F.concat_ws(":", uid, name, generation.cast("string")), 256)


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def kind_status(deprecated: Column) -> Column:
    return F.when(F.coalesce(deprecated, F.lit(False)), F.lit("Deprecated")).otherwise(F.lit("Active"))


def connect_path(namespace: Column, workspace: Column, port: Column) -> Column:
    return F.format_string("/workspace/connect/%s/%s/%s/", namespace, workspace, port)


def audit_cols(created_ms: Column, deleted_ms: Column, annotations: Column) -> list[Column]:
    """created/updated/deleted at and by; ``updated_at`` is null when its text is not RFC 3339."""
    return [
        created_ms.alias("created_at_ms"),
        F.try_element_at(annotations, F.lit(C.CREATED_BY)).alias("created_by"),
        F.unix_millis(parse_rfc3339(F.try_element_at(annotations, F.lit(C.UPDATED_AT)))).alias("updated_at_ms"),
        F.try_element_at(annotations, F.lit(C.UPDATED_BY)).alias("updated_by"),
        deleted_ms.alias("deleted_at_ms"),
    ]


def stamp_create(annotations: Column, actor: Column) -> Column:
    """Set created-by and updated-by; without an actor remove all three marks."""
    current = F.coalesce(annotations, empty_labels())
    unmarked = F.map_filter(current, lambda key, _value: ~key.isin(C.CREATED_BY, C.UPDATED_BY, C.UPDATED_AT))
    marks = F.create_map(F.lit(C.CREATED_BY), actor, F.lit(C.UPDATED_BY), actor)
    return F.when(actor.isNull(), unmarked).otherwise(merge_maps(current, marks))


def stamp_update(annotations: Column, actor: Column, now_text: Column) -> Column:
    """Set updated-at; set updated-by, or remove it when there is no actor."""
    current = merge_maps(annotations, F.create_map(F.lit(C.UPDATED_AT), now_text))
    unmarked = F.map_filter(current, lambda key, _value: key != C.UPDATED_BY)
    return F.when(actor.isNull(), unmarked).otherwise(
        F.map_concat(unmarked, F.create_map(F.lit(C.UPDATED_BY), actor))
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys`` where null equals null; the keys of the left side stay."""
    renamed = right.select([F.col(c).alias(f"_right_{c}" if c in keys else c) for c in right.columns])
    equal = [F.col(key).eqNullSafe(F.col(f"_right_{key}")) for key in keys]
    return left.join(renamed, equal, how).drop(*[f"_right_{key}" for key in keys])


def join_full_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full join on ``keys`` where null equals null; the keys of either side are told."""
    renamed = right.select(F.lit(True).alias("_right_there"), *[F.col(c).alias(f"_right_{c}" if c in keys else c) for c in right.columns])
    equal = [F.col(key).eqNullSafe(F.col(f"_right_{key}")) for key in keys]
    joined = left.withColumn("_left_there", F.lit(True)).join(renamed, equal, "full_outer")
    chosen = [F.when(F.col("_left_there"), F.col(key)).otherwise(F.col(f"_right_{key}")).alias(key) for key in keys]
    return joined.select(*chosen, *[c for c in joined.columns if c not in keys and not c.startswith(("_right_", "_left_there"))])
