"""Workspace state from its set, pod, events and configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.operators.aggregates import last_warning
from fleetloom.operators.audits import first_port_error
from fleetloom.operators.joins import main_container
from fleetloom.operators.redirects import Closure, resolve_workspaces

# State messages.
MSG_UNKNOWN_KIND = "Workspace references unknown WorkspaceKind: %s"
MSG_INVALID_IMAGE = "Workspace has invalid imageConfig: %s"
MSG_INVALID_POD = "Workspace has invalid podConfig: %s"
MSG_MULTIPLE = "Workspace owns multiple %ss: %s and %d more"
MSG_SERVICE_FAILED = "Failed to generate Service with error: %s"
MSG_POD_FOREIGN = "Workspace Pod %s is not owned by the Workspace StatefulSet %s"
MSG_UNKNOWN = "Workspace is in an unknown state"
MSG_SET_RECONCILE = "Workspace is pending: Waiting for Kubernetes to reconcile StatefulSet"
MSG_PAUSED = "Workspace is paused"
MSG_SET_WARNING = "Workspace StatefulSet has warning event: %s"
MSG_POD_CREATE = "Workspace is pending: Waiting for Pod to be created"
MSG_TERMINATING = "Workspace is terminating"
MSG_POD_UPDATE = "Workspace is pending: Waiting for Pod to be updated"
MSG_UNSCHEDULABLE = "Workspace Pod is unschedulable: %s"
MSG_SCHEDULING_GATE = "Workspace Pod is waiting for scheduling gate: %s"
MSG_SCHEDULER_ERROR = "Workspace Pod has scheduler error: %s"
MSG_RUNNING = "Workspace is running"
MSG_CRASH_LOOP = "Workspace Container is not running (CrashLoopBackOff): %s"
MSG_IMAGE_PULL = "Workspace Container is not running (ImagePullBackOff): %s"
MSG_POD_WARNING = "Workspace Pod has warning event: %s"
MSG_POD_PENDING = "Workspace is pending: Pod is pending"
MSG_NOT_READY = "Workspace is pending: Pod is running but not ready: %s"
MSG_POD_FAILED = "Workspace Pod in failed phase"


def _text(message: str, *values: Column) -> Column:
    if not values:
        return F.lit(message)
    return F.format_string(message, *[F.coalesce(value, F.lit("")) for value in values])


def _last_condition(kind: str, *fields: str) -> Column:
    last = F.try_element_at(F.filter("conditions", lambda c: c["type"] == kind), F.lit(-1))
    return F.when(last.isNotNull(), F.struct(*[last[field].alias(field) for field in fields]))


# Types of which a workspace owns one object each, in the order in which doubles are found.
ACCOUNT, SET, SERVICE, ROUTE = "ServiceAccount", "StatefulSet", "Service", "VirtualService"


def owned_census(sets: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(namespace, name, set, owned): what each workspace owns, by one aggregate over the objects of all types.

    ``owned`` has the number and the smallest name of the objects of each type, ``set`` is the set of smallest name.
    ``others`` are (namespace, owner, type, name); types that a workspace may own many of are not counted. Objects are
    reduced before they move, so an owner of most objects is one row a task. A ``warning`` of ``sets`` stays with its set.
    """
    told = ["warning"] if "warning" in sets.columns else []
    chosen = F.struct("name", "uid", "generation", "observed_generation", "update_revision", *told).alias("set")
    rows = sets.select("namespace", "owner", F.lit(SET).alias("type"), "name", chosen)
    if others is not None:
        told = others.filter(F.col("type").isin(ACCOUNT, SERVICE, ROUTE)).select("namespace", "owner", "type", "name")
        rows = rows.unionByName(told, allowMissingColumns=True)

    def counted(kind: str) -> Column:
        own = F.col("type") == kind
        return F.struct(F.count_if(own).alias("count"), F.min(F.when(own, F.col("name"))).alias("first")).alias(kind)

    census = F.struct(*[counted(kind) for kind in (ACCOUNT, SET, SERVICE, ROUTE)]).alias("owned")
    first = F.min_by("set", F.when(F.col("type") == SET, F.struct("name", "set.uid"))).alias("set")
    return rows.groupBy("namespace", F.col("owner").alias("name")).agg(first, census)


def state_inputs(
    workspaces: DataFrame,
    kinds: DataFrame,
    options: DataFrame,
    closure: Closure,
    sets: DataFrame,
    pods: DataFrame,
    events: DataFrame,
    others: DataFrame | None = None,
) -> DataFrame:
    """What the decision list reads, one row per workspace. ``others`` are owned objects besides sets.

    Events are reduced to the last warning per uid before they are joined, so a crashing pod that owns most of them adds
    a single row. The rows of workspaces are the widest, so warnings are joined to sets and pods instead, pods are reduced
    to what is read of them, and names of owned objects stay only where there are several: the rows move for their
    options, their name and their pod.
    """
    known = kinds.select(F.col("name").alias("kind"), F.lit(True).alias("kind_known"))
    ports = first_port_error(options, kinds)
    asked = workspaces.select("namespace", "name", "kind", "paused", "image_id", "pod_id")
    # ports and images have the same key, so that they share a shuffle
    rows = resolve_workspaces(asked.join(ports, ["kind", "image_id"], "left"), options, closure)
    rows = rows.join(known, "kind", "left").select(
        "namespace", "name", "kind", "paused", "kind_known", "image_error", "pod_error", "port_error"
    )
    warnings = last_warning(events).select("namespace", "uid", F.struct("message").alias("warning"))
    census = owned_census(sets.join(warnings, ["namespace", "uid"], "left"), others)

    def several(kind: str) -> Column:
        count, first = F.col(f"owned.{kind}.count"), F.col(f"owned.{kind}.first")
        return F.struct(count.alias("count"), F.when(count > 1, first).alias("first")).alias(kind)

    owned = F.struct(*[several(kind) for kind in (ACCOUNT, SET, SERVICE, ROUTE)])
    main = main_container(F.col("containers"))
    waiting = F.struct(*[main[field].alias(field) for field in ("waiting_reason", "waiting_message")])
    pod = pods.select(
        "namespace",
        "uid",
        F.col("name").alias("pod_name"),
        F.struct("name", "uid", "owner_uid", "revision", "phase", "deleting").alias("pod"),
        _last_condition("PodScheduled", "status", "reason", "message").alias("scheduled"),
        _last_condition("Ready", "status", "message").alias("ready"),
        F.when(main.isNotNull(), waiting).alias("main"),
    )
    pod = pod.join(warnings.withColumnRenamed("warning", "pod_warning"), ["namespace", "uid"], "left").drop("uid")
    return (
        rows.join(census.withColumn("owned", F.when(F.col("owned").isNotNull(), owned)), ["namespace", "name"], "left")
        .withColumn("pod_name", F.concat("set.name", F.lit("-0")))
        .join(pod, ["namespace", "pod_name"], "left")
        .withColumn("set_warning", F.col("set.warning"))
    )


def derive_state(inputs: DataFrame) -> DataFrame:
    """(namespace, name, state, state_message) by an ordered decision list; the first hit wins."""
    col = F.col
    no_pod = col("pod").isNull()
    scheduled = F.coalesce(col("scheduled.status") == "True", F.lit(False))
    ready = F.coalesce(col("ready.status") == "True", F.lit(False))
    reason, phase = col("scheduled.reason"), col("pod.phase")
    waiting, waiting_text = col("main.waiting_reason"), col("main.waiting_message")

    def doubled(kind: str) -> tuple[Column, str, Column]:
        count = col(f"owned.{kind}.count")
        message = F.format_string(MSG_MULTIPLE, F.lit(kind), F.coalesce(f"owned.{kind}.first", F.lit("")), F.coalesce(count, F.lit(0)) - 1)
        return count > 1, "Error", message

    decisions = [
        (col("kind_known").isNull(), "Error", _text(MSG_UNKNOWN_KIND, col("kind"))),
        (col("image_error").isNotNull(), "Error", _text(MSG_INVALID_IMAGE, col("image_error"))),
        (col("pod_error").isNotNull(), "Error", _text(MSG_INVALID_POD, col("pod_error"))),
        doubled(ACCOUNT),
        doubled(SET),
        (col("port_error").isNotNull(), "Error", _text(MSG_SERVICE_FAILED, col("port_error"))),
        doubled(SERVICE),
        doubled(ROUTE),
        (
            ~no_pod & ~F.coalesce(col("pod.owner_uid") == col("set.uid"), F.lit(False)),
            "Error",
            _text(MSG_POD_FOREIGN, col("pod.name"), col("set.name")),
        ),
        (col("set").isNull(), "Unknown", _text(MSG_UNKNOWN)),
        (col("set.generation") != col("set.observed_generation"), "Pending", _text(MSG_SET_RECONCILE)),
        (no_pod & col("paused"), "Paused", _text(MSG_PAUSED)),
        (no_pod & col("set_warning").isNotNull(), "Error", _text(MSG_SET_WARNING, col("set_warning.message"))),
        (no_pod, "Pending", _text(MSG_POD_CREATE)),
        (col("pod.deleting"), "Terminating", _text(MSG_TERMINATING)),
        (
            ~F.coalesce(col("pod.revision"), F.lit("")).eqNullSafe(F.coalesce(col("set.update_revision"), F.lit(""))),
            "Pending",
            _text(MSG_POD_UPDATE),
        ),
        (~scheduled & (reason == "Unschedulable"), "Error", _text(MSG_UNSCHEDULABLE, col("scheduled.message"))),
        (~scheduled & (reason == "SchedulingGated"), "Error", _text(MSG_SCHEDULING_GATE, col("scheduled.message"))),
        (~scheduled & (reason == "SchedulerError"), "Error", _text(MSG_SCHEDULER_ERROR, col("scheduled.message"))),
        ((phase == "Running") & ready, "Running", _text(MSG_RUNNING)),
        (waiting == "CrashLoopBackOff", "Error", _text(MSG_CRASH_LOOP, waiting_text)),
        (waiting == "ImagePullBackOff", "Error", _text(MSG_IMAGE_PULL, waiting_text)),
        (col("pod_warning").isNotNull(), "Error", _text(MSG_POD_WARNING, col("pod_warning.message"))),
        (phase == "Pending", "Pending", _text(MSG_POD_PENDING)),
        (phase == "Running", "Pending", _text(MSG_NOT_READY, col("ready.message"))),
        (phase == "Failed", "Error", _text(MSG_POD_FAILED)),
    ]
    chain = F
    for condition, state, message in decisions:
        chain = chain.when(condition, F.struct(F.lit(state).alias("state"), message.alias("state_message")))
    outcome = chain.otherwise(F.struct(F.lit("Unknown").alias("state"), F.lit(MSG_UNKNOWN).alias("state_message")))
    return inputs.select("namespace", "name", outcome.alias("s")).select("namespace", "name", "s.*")
