"""Denormalised views, one row (or a few) per workspace or kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom import constants as C
from fleetloom.functions import columns as K
from fleetloom.functions.labels import merge_maps
from fleetloom.operators.joins import asset_status, image_ports, with_current_option, with_kind


def option_info(known: Column, option_id: Column, display: Column, description: Column, sentinel: str) -> Column:
    """Display info of an option; an unknown id gets the sentinel as name and description."""
    return F.struct(
        option_id.alias("id"),
        F.when(known, display).otherwise(F.lit(sentinel)).alias("display_name"),
        F.when(known, F.coalesce(description, F.lit(""))).otherwise(F.lit(sentinel)).alias("description"),
    )


def workspace_view(workspaces: DataFrame, kinds: DataFrame, options: DataFrame) -> DataFrame:
    """One row per workspace: kind, times, state, options, activity and audit."""
    kind_columns = kinds.select("name", "display_name", "icon", "logo")
    option_columns = options.select("kind", "option_type", "id", "display_name", "description", "labels", "ports")
    joined = with_current_option(with_kind(workspaces, kind_columns), option_columns)

    def info(option_type: str, sentinel: str) -> Column:
        column = F.col
        return option_info(
            column(f"{option_type}_known"),
            column(f"{option_type}_id"),
            column(f"{option_type}_opt_display_name"),
            column(f"{option_type}_opt_description"),
            sentinel,
        )

    return joined.select(
        "namespace",
        "name",
        F.coalesce("display_name", F.lit("")).alias("display_name"),
        "kind",
        "kind_missing",
        "paused",
        "pause_ms",
        "last_running_ms",
        "state",
        "state_message",
        info("image", C.UNKNOWN_IMAGE).alias("image"),
        F.when(F.col("image_known"), F.col("image_opt_labels")).alias("image_labels"),
        info("pod", C.UNKNOWN_POD).alias("pod"),
        F.when(F.col("pod_known"), F.col("pod_opt_labels")).alias("pod_labels"),
        F.when(F.col("image_known"), F.size("image_opt_ports")).cast("bigint").alias("service_count"),
        "last_activity_ms",
        "last_update_ms",
        *K.audit_cols(F.col("created_ms"), F.lit(None).cast("bigint"), F.col("annotations")),
    )


def workspace_details(workspaces: DataFrame, kinds: DataFrame, mounts: DataFrame) -> DataFrame:
    """One row per mount of a workspace (or one without mounts): pod, and the home path taken from the kind."""
    base = with_kind(workspaces.select("namespace", "name", "kind", "pod_name"), kinds.select("name", "home_path"))
    home = F.when(F.col("kind_missing"), F.lit(C.UNKNOWN_HOME)).otherwise(F.col("kind_home_path"))
    rows = mounts.withColumnRenamed("workspace", "name")
    return base.join(rows, ["namespace", "name"], "left").select(
        "namespace",
        "name",
        F.when(F.col("pod_name") != "", F.col("pod_name")).alias("pod"),
        "source",
        "target",
        F.when(F.col("source") == "home", home).otherwise(F.col("mount_path")).alias("mount_path"),
        F.when(F.col("source").isNotNull(), F.coalesce((F.col("source") == "data") & F.col("read_only"), F.lit(False)))
        .alias("read_only"),
    )


def service_urls(workspaces: DataFrame, options: DataFrame, kinds: DataFrame) -> DataFrame:
    """Connect path, display name, prefix-strip flag and target port per HTTP service of a workspace."""
    ports = image_ports(options, kinds).filter(F.col("protocol") == "HTTP")
    return workspaces.select("namespace", "name", "kind", "image_id").join(ports, ["kind", "image_id"]).select(
        "namespace",
        "name",
        "port_id",
        F.coalesce("port_display_name", "default_display_name").alias("display_name"),
        K.connect_path(F.col("namespace"), F.col("name"), F.col("port_id")).alias("path"),
        "remove_prefix",
        F.col("port").alias("target_port"),
    )


# Fixed value: the path under which the images of a kind are served.
ASSET_PATH = "/api/v1/workspacekinds/"


def asset_ref(kinds: DataFrame, assets: DataFrame, url_prefix: str = "", path: str = ASSET_PATH) -> DataFrame:
    """URL and error code of each kind's icon and logo."""
    stored = F.concat(
        F.lit(url_prefix.rstrip("/") + path),
        F.col("kind"),
        F.lit("/assets/"),
        F.col("asset"),
        F.when(F.col("sha256").isNotNull(), F.concat(F.lit("?sha256="), F.col("sha256"))).otherwise(F.lit("")),
    )
    code = (
        F.when(F.col("error") == "NotFound", F.lit(C.ASSET_MISSING))
        .when(F.col("error") == "KeyNotFound", F.lit(C.ASSET_KEY_MISSING))
        .when(F.col("error") == "Other", F.lit(C.ASSET_OTHER))
        .when(F.col("error").isNotNull(), F.lit(C.ASSET_UNKNOWN))
    )
    return asset_status(kinds, assets).select(
        "kind", "asset", F.coalesce("url", stored).alias("url"), code.alias("error")
    )


def merge_metadata(kind: Column, option: Column, workspace: Column, system: Column) -> Column:
    """System labels over workspace over option over kind."""
    return merge_maps(kind, option, workspace, system)


def merge_env(base: Column, override: Column) -> Column:
    """Ordered merge by name: an override replaces in place, new names are appended in declared order."""
    empty = F.array().cast("array<struct<name:string,value:string>>")
    base, override = F.coalesce(base, empty), F.coalesce(override, empty)

    def last_of(name: Column) -> Column:
        return F.try_element_at(F.filter(override, lambda o: o["name"] == name), F.lit(-1))

    def later_same(entries: Column, entry: Column, i: Column) -> Column:
        rest = F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0)))
        return F.exists(rest, lambda other: other["name"] == entry["name"])

    replaced = F.transform(
        base, lambda b, i: F.when(later_same(base, b, i), b).otherwise(F.coalesce(last_of(b["name"]), b))
    )
    fresh = F.filter(override, lambda o: ~F.exists(base, lambda b: b["name"] == o["name"]))
    first = F.filter(fresh, lambda o, i: ~F.exists(F.slice(fresh, 1, i), lambda other: other["name"] == o["name"]))
    return F.concat(replaced, F.transform(first, lambda o: last_of(o["name"])))


def effective_settings(workspaces: DataFrame, kinds: DataFrame, options: DataFrame) -> DataFrame:
    """Replicas, pull policy, scheduler and resources; only for workspaces whose kind and options exist."""
    kind_columns = kinds.select("name", "scheduler")
    option_columns = options.select("kind", "option_type", "id", "scheduler", "pull_policy", "resources")
    joined = with_current_option(with_kind(workspaces, kind_columns), option_columns)
    return joined.filter(~F.col("kind_missing") & F.col("image_known") & F.col("pod_known")).select(
        "namespace",
        "name",
        F.when(F.col("paused"), F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("replicas"),
        F.coalesce("image_opt_pull_policy", F.lit("IfNotPresent")).alias("pull_policy"),
        F.coalesce("pod_opt_scheduler", "kind_scheduler", F.lit("")).alias("scheduler"),
        F.col("pod_opt_resources").alias("resources"),
    )


# Mount precedence, earlier wins.
MOUNT_CLASSES = ("home", "data", "secret")


def _mount_candidates(workspaces: DataFrame, kinds: DataFrame, mounts: DataFrame) -> DataFrame:
    known = workspaces.select("namespace", F.col("name").alias("workspace"), "kind").join(
        kinds.select(F.col("name").alias("kind"), "home_path"), "kind"
    )
    source = F.col("source")
    rank = F.when(source == "home", 0).when(source == "data", 1).otherwise(2)
    own = mounts.join(known, ["namespace", "workspace"]).select(
        "namespace",
        "workspace",
        F.when(source == "home", F.col("home_path")).otherwise(F.col("mount_path")).alias("mount_path"),
        F.struct(
            rank.alias("class"),
            F.col("pos").alias("pos"),
            F.when(source == "home", F.lit("home-volume"))
            .otherwise(F.concat(source, F.lit("-volume-"), F.col("pos").cast("string")))
            .alias("volume"),
            F.col("target").alias("target"),
            F.coalesce((source == "data") & F.col("read_only"), F.lit(False)).alias("read_only"),
        ).alias("m"),
    )
    return own


def _first_by_path(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("namespace", "workspace", "mount_path").agg(F.min("m").alias("m"))


def all_mount_candidates(workspaces: DataFrame, kinds: DataFrame, mounts: DataFrame) -> DataFrame:
    """Own mounts, then the kind's extra mounts whose volume is known to the workspace."""
    own = _mount_candidates(workspaces, kinds, mounts)
    extras = (
        workspaces.select("namespace", F.col("name").alias("workspace"), "kind")
        .join(kinds.select(F.col("name").alias("kind"), "extra_mounts", "extra_volumes"), "kind")
        .select("namespace", "workspace", "extra_volumes", F.posexplode("extra_mounts").alias("pos", "e"))
    )
    accepted = _first_by_path(own).select("namespace", "workspace", F.col("m.volume").alias("volume")).distinct()
    declared = extras.filter(F.array_contains("extra_volumes", F.col("e.name")))
    borrowed = (
        extras.filter(~F.array_contains("extra_volumes", F.col("e.name")))
        .withColumn("volume", F.col("e.name"))
        .join(accepted, ["namespace", "workspace", "volume"], "left_semi")
        .drop("volume")
    )
    extra = declared.unionByName(borrowed).select(
        "namespace",
        "workspace",
        F.col("e.mount_path").alias("mount_path"),
        F.struct(
            F.lit(3).alias("class"),
            F.col("pos").cast("bigint").alias("pos"),
            F.col("e.name").alias("volume"),
            F.lit(None).cast("string").alias("target"),
            F.lit(False).alias("read_only"),
        ).alias("m"),
    )
    return own.unionByName(extra)


def _mount_columns(df: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(name) for name in (*MOUNT_CLASSES, "extra")])
    return df.select(
        "namespace",
        "workspace",
        "mount_path",
        F.get(names, F.col("m.class")).alias("source"),
        F.col("m.volume").alias("volume"),
        F.col("m.target").alias("target"),
        F.col("m.read_only").alias("read_only"),
    )


def effective_mounts(workspaces: DataFrame, kinds: DataFrame, mounts: DataFrame) -> DataFrame:
    """The mount that takes each path: home, data, secret, then extra; the first wins."""
    return _mount_columns(_first_by_path(all_mount_candidates(workspaces, kinds, mounts)))


def dropped_mounts(workspaces: DataFrame, kinds: DataFrame, mounts: DataFrame) -> DataFrame:
    """Mounts that lost their path to an earlier one."""
    candidates = all_mount_candidates(workspaces, kinds, mounts)
    winners = _first_by_path(candidates).withColumnRenamed("m", "winner")
    keys = ["namespace", "workspace", "mount_path"]
    return _mount_columns(candidates.distinct().join(winners, keys).filter(F.col("m") != F.col("winner")))

