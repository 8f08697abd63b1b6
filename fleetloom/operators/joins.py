"""Joins of the fleet tables.

Lists such as "pods of a claim" are returned as rows, never collected into one array: a popular claim may be
used by a third of the fleet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.constants import CAN_MOUNT, MAIN_CONTAINER, WORKSPACE_LABEL
from fleetloom.functions.columns import content_hash, redirect_level
from fleetloom.functions.labels import label_is_true


def _prefixed(df: DataFrame, prefix: str, keep: dict[str, str]) -> DataFrame:
    renamed = {column: keep.get(column, f"{prefix}{column}") for column in df.columns}
    return df.select(*[F.col(column).alias(name) for column, name in renamed.items()])


def with_kind(workspaces: DataFrame, kinds: DataFrame) -> DataFrame:
    """Left join on the kind; its columns get the prefix ``kind_``; ``kind_missing`` marks unknown kinds."""
    info = _prefixed(kinds, "kind_", {"name": "kind"}).withColumn("_kind_found", F.lit(True))
    joined = workspaces.join(info, "kind", "left")
    return joined.withColumn("kind_missing", F.col("_kind_found").isNull()).drop("_kind_found")


def with_current_option(workspaces: DataFrame, options: DataFrame) -> DataFrame:
    """Left join the selected image and pod options (prefixes ``image_`` and ``pod_``) with known flags."""
    for option_type in ("image", "pod"):
        wanted = options.filter(F.col("option_type") == option_type).drop("option_type")
        info = _prefixed(wanted, f"{option_type}_opt_", {"kind": "kind", "id": f"{option_type}_id"})
        info = info.withColumn(f"{option_type}_known", F.lit(True))
        workspaces = workspaces.join(info, ["kind", f"{option_type}_id"], "left").withColumn(
            f"{option_type}_known", F.coalesce(f"{option_type}_known", F.lit(False))
        )
    return workspaces


def annotate_chain(steps: DataFrame, options: DataFrame, unknown: Column) -> DataFrame:
    """Display info of both ends of each redirect step (kind, option_type, source, target, ...).

    The message is kept only when the source's redirect still points at the step's target.
    """
    info = options.select("kind", "option_type", "id", "display_name", "redirect")
    source = info.select(
        "kind",
        "option_type",
        F.col("id").alias("source"),
        F.col("display_name").alias("source_display"),
        F.col("redirect").alias("source_redirect"),
        F.lit(True).alias("source_known"),
    )
    target = info.select(
        "kind",
        "option_type",
        F.col("id").alias("target"),
        F.col("display_name").alias("target_display"),
        F.lit(True).alias("target_known"),
    )
    expected = F.coalesce(F.col("source_redirect.to") == F.col("target"), F.lit(False)) & F.col(
        "source_redirect.text"
    ).isNotNull()
    return (
        steps.join(source, ["kind", "option_type", "source"], "left")
        .join(target, ["kind", "option_type", "target"], "left")
        .withColumn("source_display", F.when(F.col("source_known"), F.col("source_display")).otherwise(unknown))
        .withColumn("target_display", F.when(F.col("target_known"), F.col("target_display")).otherwise(unknown))
        .withColumn("message_level", F.when(expected, redirect_level(F.col("source_redirect.level"))))
        .withColumn("message_text", F.when(expected, F.col("source_redirect.text")))
        .drop("source_redirect", "source_known", "target_known")
    )


def claim_pods(pods: DataFrame) -> DataFrame:
    """(namespace, claim, pod, ...) once per pod and claim."""
    return pods.select(
        "namespace",
        F.explode(F.array_distinct("claims")).alias("claim"),
        F.col("name").alias("pod"),
        F.col("phase").alias("pod_phase"),
        F.col("node").alias("pod_node"),
    )


def pvc_pods(pvcs: DataFrame, pods: DataFrame) -> DataFrame:
    """One row per claim and pod using it; a claim without pods keeps one row with a null pod."""
    return pvcs.select("namespace", F.col("name").alias("claim")).join(claim_pods(pods), ["namespace", "claim"], "left")


def claim_workspaces(mounts: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(namespace, claim, workspace, ...) once per workspace and claim, home and data mounts only."""
    used = (
        mounts.filter(F.col("source") != "secret")
        .select("namespace", "workspace", F.col("target").alias("claim"))
        .distinct()
    )
    known = workspaces.select("namespace", F.col("name").alias("workspace"), "state", "pod_name")
    return used.join(known, ["namespace", "workspace"])


def pvc_workspaces(pvcs: DataFrame, mounts: DataFrame, workspaces: DataFrame) -> DataFrame:
    """One row per claim and workspace mounting it; an unused claim keeps one row with a null workspace."""
    return pvcs.select("namespace", F.col("name").alias("claim")).join(
        claim_workspaces(mounts, workspaces), ["namespace", "claim"], "left"
    )


def pvc_volume(pvcs: DataFrame, pvs: DataFrame, storage_classes: DataFrame) -> DataFrame:
    """Claim, its volume and the class; class info only when the volume exists."""
    volume = pvs.select(
        F.col("name").alias("volume"), F.col("uid").alias("volume_uid"), "reclaim", F.col("mode").alias("volume_mode")
    )
    classes = storage_classes.select(
        F.col("name").alias("storage_class"),
        F.col("uid").alias("class_uid"),
        F.try_element_at("annotations", F.lit("display-name")).alias("class_display_name"),
    )
    exists = F.col("volume_uid").isNotNull()
    joined = pvcs.join(volume, "volume", "left").join(classes, "storage_class", "left")
    for column in ("class_uid", "class_display_name"):
        joined = joined.withColumn(column, F.when(exists, F.col(column)))
    return joined


def secret_mounts(secrets: DataFrame, mounts: DataFrame, workspaces: DataFrame) -> DataFrame:
    """One row per secret and workspace mounting it; an unused secret keeps one row with a null workspace."""
    used = (
        mounts.filter(F.col("source") == "secret")
        .select("namespace", F.col("target").alias("secret"), "workspace")
        .distinct()
        .join(workspaces.select("namespace", F.col("name").alias("workspace")), ["namespace", "workspace"], "left_semi")
    )
    return secrets.select("namespace", F.col("name").alias("secret")).join(used, ["namespace", "secret"], "left")


def latest_usage(usage: DataFrame, order: list[str]) -> DataFrame:
    """Newest sample per container, a partial aggregate so that a hot pod shrinks before the shuffle."""
    newest = F.max_by(F.struct("ts", "cpu", "memory"), F.struct(*order))
    return (
        usage.groupBy("namespace", "pod", "container")
        .agg(newest.alias("s"))
        .select("namespace", "pod", "container", F.col("s.ts"), F.col("s.cpu"), F.col("s.memory"))
    )


def pod_containers(pods: DataFrame) -> DataFrame:
    return pods.select(
        "namespace", F.col("name").alias("pod"), F.explode(F.filter("containers", lambda c: ~c["init"])).alias("c")
    ).select(
        "namespace",
        "pod",
        F.col("c.name").alias("container"),
        F.col("c.requests").alias("requests"),
        F.col("c.limits").alias("limits"),
    )


def container_usage(pods: DataFrame, usage: DataFrame, order: list[str]) -> DataFrame:
    """Containers of the pod spec with their newest usage; usage of other containers is dropped."""
    return pod_containers(pods).join(latest_usage(usage, order), ["namespace", "pod", "container"], "left")


def option_ports(options: DataFrame) -> DataFrame:
    return options.filter(F.col("option_type") == "image").select(
        "kind", F.col("id").alias("image_id"), F.posexplode("ports").alias("port_pos", "p")
    ).select(
        "kind",
        "image_id",
        F.col("port_pos").cast("bigint").alias("port_pos"),
        F.col("p.id").alias("port_id"),
        F.col("p.port").cast("bigint").alias("port"),
        F.col("p.display_name").alias("port_display_name"),
    )


def kind_ports(kinds: DataFrame) -> DataFrame:
    return kinds.select(F.col("name").alias("kind"), F.explode("ports").alias("p")).select(
        "kind",
        F.col("p.id").alias("port_id"),
        F.col("p.protocol").alias("protocol"),
        F.col("p.default_display_name").alias("default_display_name"),
        F.coalesce(F.col("p.remove_prefix"), F.lit(False)).alias("remove_prefix"),
    )


def image_ports(options: DataFrame, kinds: DataFrame) -> DataFrame:
    """Ports of each image with the kind's definition; undefined ids are reported by the audits."""
    return option_ports(options).join(kind_ports(kinds), ["kind", "port_id"])


def workspace_uids(workspaces: DataFrame) -> DataFrame:
    """(namespace, uid, workspace) for the pod and the set of each workspace; empty uids are ignored."""
    return (
        workspaces.select(
            "namespace", F.col("name").alias("workspace"), F.explode(F.array("pod_uid", "set_uid")).alias("uid")
        )
        .filter(F.col("uid") != "")
        .distinct()
    )


def event_owner(events: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Events joined to the workspace that owns the involved uid, in the same namespace only."""
    involved = events.filter(F.col("involved_uid") != "").withColumnRenamed("involved_uid", "uid")
    return involved.join(workspace_uids(workspaces), ["namespace", "uid"])


def affected_workspaces(changed_kinds: DataFrame, workspaces: DataFrame) -> DataFrame:
    return workspaces.join(changed_kinds.select(F.col("name").alias("kind")), "kind", "left_semi")


def kind_asset_refs(kinds: DataFrame) -> DataFrame:
    """Icon and logo of each kind as rows."""
    return kinds.select(
        F.col("name").alias("kind"),
        F.explode(
            F.array(
                F.struct(F.lit("icon").alias("asset"), F.col("icon").alias("ref")),
                F.struct(F.lit("logo").alias("asset"), F.col("logo").alias("ref")),
            )
        ).alias("r"),
    ).select(
        "kind",
        F.col("r.asset").alias("asset"),
        F.col("r.ref.url").alias("url"),
        F.col("r.ref.namespace").alias("namespace"),
        F.col("r.ref.name").alias("name"),
        F.col("r.ref.key").alias("key"),
    )


def affected_kinds(changed_assets: DataFrame, kinds: DataFrame) -> DataFrame:
    """Kinds whose icon or logo lives in a changed object."""
    changed = changed_assets.select("namespace", "name")
    return kind_asset_refs(kinds).join(changed, ["namespace", "name"], "left_semi").select("kind").distinct()


def content_hashes(assets: DataFrame) -> DataFrame:
    """sha-256 per (object, key); binary content wins over text under the same key.

    Content is hashed before the shuffle, so only 64 characters per entry move.
    """
    hashed = assets.select("namespace", "name", "key", "is_binary", content_hash(F.col("content")).alias("sha256"))
    return hashed.groupBy("namespace", "name", "key").agg(
        F.max_by("sha256", F.struct("is_binary", "sha256")).alias("sha256")
    )


def asset_status(kinds: DataFrame, assets: DataFrame) -> DataFrame:
    """Status of each kind's icon and logo: empty for URLs, an error when object or key is missing, else the hash."""
    refs = kind_asset_refs(kinds)
    wanted = refs.filter(F.col("url").isNull()).select("namespace", "name").distinct()
    held = assets.join(wanted, ["namespace", "name"], "left_semi")
    objects = held.select("namespace", "name").distinct().withColumn("object_found", F.lit(True))
    keys = refs.filter(F.col("url").isNull()).select("namespace", "name", "key").distinct()
    hashes = content_hashes(held.join(keys, ["namespace", "name", "key"], "left_semi"))
    return (
        refs.join(objects, ["namespace", "name"], "left")
        .join(hashes, ["namespace", "name", "key"], "left")
        .withColumn(
            "error",
            F.when(F.col("url").isNotNull() | F.col("name").isNull(), F.lit(None))
            .when(F.col("object_found").isNull(), F.lit("NotFound"))
            .when(F.col("sha256").isNull(), F.lit("KeyNotFound")),
        )
        .drop("object_found")
    )


def pod_for_workspace(sets: DataFrame, pods: DataFrame) -> DataFrame:
    """The set's pod, found by name ``{set}-0``; ``pod_foreign`` marks a pod another owner holds."""
    by_name = pods.select(
        "namespace",
        F.col("name").alias("pod_name"),
        F.col("uid").alias("found_pod_uid"),
        F.col("owner_uid").alias("pod_owner_uid"),
    )
    joined = sets.withColumn("pod_name", F.concat("name", F.lit("-0"))).join(by_name, ["namespace", "pod_name"], "left")
    return joined.withColumn(
        "pod_foreign",
        F.col("found_pod_uid").isNotNull() & ~F.coalesce(F.col("pod_owner_uid") == F.col("uid"), F.lit(False)),
    )


def workspace_pods_by_label(workspaces: DataFrame, pods: DataFrame, key: str = WORKSPACE_LABEL) -> DataFrame:
    """The first pod (by name) labelled with the workspace; none means not running."""
    first = (
        pods.withColumn("workspace", F.try_element_at("labels", F.lit(key)))
        .filter(F.col("workspace").isNotNull())
        .groupBy("namespace", "workspace")
        .agg(F.min(F.struct("name", "uid", "phase")).alias("p"))
        .select("namespace", "workspace", F.col("p.name").alias("pod"), F.col("p.phase").alias("pod_phase"))
    )
    return (
        workspaces.withColumnRenamed("name", "workspace")
        .join(first, ["namespace", "workspace"], "left")
        .withColumn("running", F.col("pod").isNotNull())
    )


def mount_conflicts(mounts: DataFrame, pvcs: DataFrame, pods: DataFrame, workspaces: DataFrame) -> DataFrame:
    """For each (claim, workspace that mounts it): is another workspace or another active pod using the claim?

    Only the smallest and largest user per claim are needed to know whether a different one exists, so a claim
    with very many users stays one small partial aggregate.
    """
    users = claim_workspaces(mounts, workspaces)
    per_claim = users.groupBy("namespace", "claim").agg(
        F.min("workspace").alias("first_ws"), F.max("workspace").alias("last_ws"), F.count("*").alias("workspace_count")
    )
    active = (
        claim_pods(pods)
        .filter(~F.coalesce(F.col("pod_phase").isin("Succeeded", "Failed"), F.lit(False)))
        .groupBy("namespace", "claim")
        .agg(F.min("pod").alias("first_pod"), F.max("pod").alias("last_pod"))
    )
    claims = pvcs.select("namespace", F.col("name").alias("claim"), "access_modes", "labels")
    own = F.coalesce("pod_name", F.lit(""))
    other_ws = F.when(F.col("first_ws") != F.col("workspace"), F.col("first_ws")).when(
        F.col("last_ws") != F.col("workspace"), F.col("last_ws")
    )
    other_pod = F.when(F.col("first_pod") != own, F.col("first_pod")).when(F.col("last_pod") != own, F.col("last_pod"))
    joined = (
        users.join(claims, ["namespace", "claim"])
        .join(per_claim, ["namespace", "claim"])
        .join(active, ["namespace", "claim"], "left")
        .withColumn("other_workspace", other_ws)
        .withColumn("other_pod", other_pod)
    )
    conflict = F.col("other_workspace").isNotNull() | F.col("other_pod").isNotNull()
    return joined.select(
        "namespace",
        "claim",
        "workspace",
        "other_workspace",
        "other_pod",
        (F.array_contains("access_modes", "ReadWriteOncePod") & conflict).alias("blocked"),
        (F.array_contains("access_modes", "ReadWriteOnce") & conflict).alias("rwo_warning"),
        "workspace_count",
    )


def unmountable_reason(pvcs: DataFrame, pods: DataFrame, mounts: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Why a claim that is not labelled mountable cannot be mounted: 1 = pod uses it, 2 = workspace uses it."""
    with_pods = claim_pods(pods).select("namespace", F.col("claim").alias("name")).distinct()
    with_workspaces = claim_workspaces(mounts, workspaces).select("namespace", F.col("claim").alias("name")).distinct()
    return (
        pvcs.join(with_pods.withColumn("has_pods", F.lit(True)), ["namespace", "name"], "left")
        .join(with_workspaces.withColumn("has_workspaces", F.lit(True)), ["namespace", "name"], "left")
        .withColumn("can_mount", label_is_true(F.col("labels"), CAN_MOUNT))
        .withColumn(
            "reason",
            F.when(F.col("can_mount"), F.lit(None))
            .when(F.array_contains("access_modes", "ReadWriteOncePod") & F.col("has_pods"), F.lit(1))
            .when(F.array_contains("access_modes", "ReadWriteOnce") & F.col("has_workspaces"), F.lit(2))
            .cast("bigint"),
        )
    )


def main_container(containers: Column) -> Column:
    return F.get(F.filter(containers, lambda c: (c["name"] == MAIN_CONTAINER) & ~c["init"]), F.lit(0))
