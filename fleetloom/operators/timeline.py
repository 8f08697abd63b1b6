"""Ordered computations over state history, probes, activity levels and logs.

Per-workspace answers are partial aggregates; where the previous row is needed it comes from
:mod:`fleetloom.functions.chunked`, so no workspace is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetloom import constants as C
from fleetloom.functions.chunked import in_ranges, previous_in, sum_beside, with_previous
from fleetloom.functions.columns import join_null_safe, parse_rfc3339

WORKSPACE = ["namespace", "workspace"]
HOUR_MS = 3_600_000


def with_entered(history: DataFrame) -> DataFrame:
    """The state history with ``entered``: does the row enter Running?

    The result reads the table ``dealt``, its attribute, which a stream
    forgets once the result has been written.
    """
    order = ["ts_ms", "seq"]
    dealt = in_ranges(history, WORKSPACE, order)
    rows = previous_in(dealt, WORKSPACE, order, ["state"])
    entered = (F.col("state") == "Running") & ~F.coalesce(F.col("prev.state") == "Running", F.lit(False))
    told = rows.withColumn("entered", F.coalesce(entered, F.lit(False))).drop("prev")
    told.dealt = dealt
    return told


def running_epochs(history: DataFrame) -> DataFrame:
    """Rows of the state history that enter Running: the start of each continuous run."""
    return with_entered(history).filter("entered").drop("entered")


def running_since(history: DataFrame) -> DataFrame:
    """Start of the latest run (0 when never running), the number of runs and the latest state per workspace."""
    starts = running_epochs(history).groupBy(*WORKSPACE).agg(
        F.max("ts_ms").alias("last_running_ms"), F.count("*").alias("runs")
    )
    latest = history.groupBy(*WORKSPACE).agg(F.max_by("state", F.struct("ts_ms", "seq")).alias("state"))
    zero = F.lit(0).cast("bigint")
    return latest.join(starts, WORKSPACE, "left").select(
        *WORKSPACE,
        "state",
        F.coalesce("last_running_ms", zero).alias("last_running_ms"),
        F.coalesce("runs", zero).alias("runs"),
    )


def pause_time(history: DataFrame) -> DataFrame:
    """When the current pause began; 0 for a workspace that is not paused."""
    rows = with_previous(history, WORKSPACE, ["ts_ms", "seq"], ["paused"])
    entered = F.col("paused") & ~F.coalesce(F.col("prev.paused"), F.lit(False))
    return (
        rows.groupBy(*WORKSPACE)
        .agg(
            F.max_by("paused", F.struct("ts_ms", "seq")).alias("paused"),
            F.max(F.when(entered, F.col("ts_ms"))).alias("began"),
        )
        .select(*WORKSPACE, "paused", F.when(F.col("paused"), F.col("began")).otherwise(F.lit(0)).alias("pause_ms"))
    )


def probe_due(
    workspaces: DataFrame, now_ms: int, interval_s: Column, min_interval_s: Column, start: Column, result: Column
) -> DataFrame:
    """Is a probe due, and if not, in how many milliseconds?

    A workspace without a started probe is due at once; after a success the interval applies, otherwise the
    minimum interval.
    """
    required = F.when(result == "Success", F.coalesce(interval_s, F.lit(C.PROBE_INTERVAL_S))).otherwise(
        F.coalesce(min_interval_s, F.lit(C.PROBE_MIN_INTERVAL_S))
    ).cast("bigint") * 1000
    elapsed = F.lit(now_ms) - start
    never = start.isNull() | (start <= 0)
    waiting = ~never & (elapsed < required)
    return workspaces.withColumn("due", ~waiting).withColumn(
        "remaining_ms", F.when(waiting, required - elapsed).otherwise(F.lit(0)).cast("bigint")
    )


def probe_activity(probes: DataFrame) -> DataFrame:
    """Read the probe output: adds the final result and ``activity_ms`` (null means no activity reported).

    Only a Success has its output read; bad JSON, a wrong type or an unreadable time turn it into a Failure.
    """
    text = F.regexp_replace("output", r"^\s+|\s+$", "")
    schema = "has_activity boolean, last_activity string, _corrupt string"
    parsed = F.from_json(text, schema, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    rows = probes.withColumn("_text", text).withColumn("_json", parsed)
    active, last = F.col("_json.has_activity"), F.col("_json.last_activity")
    empty = F.coalesce(F.col("_text"), F.lit("")) == ""
    moment = F.unix_millis(parse_rfc3339(last))
    nothing = F.col("_text") == "null"
    bad = ~empty & ~nothing & (
        F.col("_json").isNull()
        | ~F.col("_text").startswith("{")
        | F.col("_json._corrupt").isNotNull()
        | (active.isNull() & last.isNotNull() & moment.isNull())
    )
    read = F.col("result") == "Success"
    activity = (
        F.when(~read | bad, F.lit(None))
        .when(empty, F.col("end_ms"))
        .when(active.isNotNull(), F.when(active, F.col("end_ms")))
        .when(last.isNotNull(), moment)
        .otherwise(F.col("end_ms"))
    )
    return rows.withColumn("activity_ms", activity.cast("bigint")).withColumn(
        "result", F.when(read & bad, F.lit("Failure")).otherwise(F.col("result"))
    ).drop("_text", "_json")


def probe_facts(probes: DataFrame, order: list[str]) -> DataFrame:
    """What the probes of each workspace say, in any order of arrival: one partial aggregate.

    ``probes`` come from :func:`probe_activity` and hold last_running_ms, the start of the run they belong to.
    """
    success = F.col("result") == "Success"
    at = F.struct(*order)
    told = success & F.col("activity_ms").isNotNull()
    silent = success & F.col("activity_ms").isNull()
    return probes.groupBy(*WORKSPACE).agg(
        F.max("last_running_ms").alias("last_running_ms"),
        F.max_by("activity_ms", F.when(told, at)).alias("told_ms"),
        F.max(F.when(told, at)).alias("told_at"),
        F.max(F.when(silent, at)).alias("silent_at"),
        F.max_by("end_ms", F.when(success, at)).alias("updated_ms"),
        F.max_by(F.struct("start_ms", "end_ms", "result"), at).alias("last_probe"),
        F.count("*").alias("probes"),
    )


def folded_activity(before: Column, running: Column) -> Column:
    """Activity after the facts, given the activity before them.

    The last told value is assigned. A silent success keeps what is known, and falls back to the start of the run
    while the activity is unknown (not positive).
    """
    told, silent = F.col("told_at").isNotNull(), F.col("silent_at").isNotNull()
    silent_last = silent & (~told | (F.col("silent_at") > F.col("told_at")))
    value = F.when(told, F.col("told_ms")).otherwise(before)
    return F.when(silent_last & (value <= 0) & (running > 0), running).otherwise(value)


def with_running(probes: DataFrame, running: DataFrame) -> DataFrame:
    """Probes of the current run of each workspace, with its start."""
    rows = probes.join(running.select(*WORKSPACE, "last_running_ms"), WORKSPACE, "left").withColumn(
        "last_running_ms", F.coalesce("last_running_ms", F.lit(0).cast("bigint"))
    )
    return rows.filter(F.col("start_ms") >= F.col("last_running_ms"))


def fold_probes(probes: DataFrame, running: DataFrame, order: list[str]) -> DataFrame:
    """Activity status per workspace after all probes since its latest run began.

    ``running`` holds last_running_ms per workspace. The activity is assigned, not maximised: it may go backwards.
    Failures change nothing but the last probe.
    """
    facts = probe_facts(with_running(probes, running), order)
    zero = F.lit(0).cast("bigint")
    return facts.select(
        *WORKSPACE,
        "last_running_ms",
        folded_activity(zero, F.col("last_running_ms")).alias("last_activity_ms"),
        F.coalesce("updated_ms", zero).alias("last_update_ms"),
        F.col("last_probe.start_ms").alias("last_probe_start_ms"),
        F.col("last_probe.result").alias("last_probe_result"),
        "probes",
    )


def activity_level(workspaces: DataFrame, now_ms: int) -> DataFrame:
    """none, warning or critical by the time left before a running workspace may be paused.

    An unknown activity gives eligible_after_ms 0, which counts as long past; ``activity_unknown`` flags it.
    """
    eligible = F.col("eligible_after_ms")
    remaining = F.when((F.col("state") == "Running") & eligible.isNotNull(), eligible - F.lit(now_ms))
    level = (
        F.when(remaining <= C.CRITICAL_MS, F.lit("critical"))
        .when(remaining <= C.WARNING_MS, F.lit("warning"))
        .otherwise(F.lit("none"))
    )
    return workspaces.select(
        "*",
        remaining.alias("remaining_ms"),
        level.alias("level"),
        (remaining.isNotNull() & (eligible == 0)).alias("activity_unknown"),
    )


def escalations(
    levels: DataFrame, first_snapshot: int | None = None, carry: list[str] | None = None
) -> DataFrame:
    """Rises of the activity level between consecutive snapshots that a user is told about.

    A workspace absent from the previous snapshot starts from none; nothing is reported for the first snapshot;
    falling from critical to warning is silent. ``carry`` names extra columns to keep. The result reads the table ``dealt``,
    its attribute, which a stream forgets once the result has been written.
    """
    dealt = in_ranges(levels, WORKSPACE, ["snapshot_id"])
    first = dealt.agg(F.min("snapshot_id")).first()[0] if first_snapshot is None else first_snapshot
    rows = previous_in(dealt, WORKSPACE, ["snapshot_id"], ["snapshot_id", "level"])
    before = F.when(F.col("prev.snapshot_id") == F.col("snapshot_id") - 1, F.col("prev.level"))
    before = F.coalesce(before, F.lit("none"))
    rises = ((before == "none") & F.col("level").isin("warning", "critical")) | (
        (before == "warning") & (F.col("level") == "critical")
    )
    told = rows.filter(rises & (F.col("snapshot_id") > F.lit(first))).select(
        *WORKSPACE, "snapshot_id", before.alias("from_level"), F.col("level").alias("to_level"), *(carry or [])
    )
    told.dealt = dealt
    return told


def log_tail(
    logs: DataFrame,
    lines: int = C.LOG_TAIL_LINES,
    since: Column | None = None,
    previous: bool = False,
    container: str | None = None,
    byte_cap: int | None = None,
    slice_ms: int = HOUR_MS,
) -> DataFrame:
    """The last lines of each container, oldest first, cut where their bytes exceed the cap, if there is one.

    Ranks come from counts. Lines are counted per container and slice of time, without reading their text, and only the
    slices that hold the last ``lines`` go on. These are dealt by ranges, whose counts and sizes place each line among the
    others, so neither many asked lines nor one busy container, hour or moment is one task. (ts, seq) orders a
    container's lines; lines without a time are the oldest.
    """
    group = ["namespace", "workspace", "container"]
    wanted = logs.filter((F.col("previous") == previous) & (F.col("container") == (container or C.MAIN_CONTAINER)))
    if since is not None:
        wanted = wanted.filter(F.col("ts") >= since)
    earliest = F.lit(-(2**63)).cast("bigint")
    wanted = wanted.withColumn("_slice", F.coalesce(F.floor(F.unix_millis("ts") / F.lit(slice_ms)), earliest))
    per_slice = wanted.groupBy(*group, F.col("_slice").alias("_range")).agg(F.count("*").alias("n"))
    start = (
        sum_beside(per_slice, group, "n", "_later", later=True)
        .filter(F.col("_later") < lines)
        .groupBy(*group)
        .agg(F.min("_range").alias("_start"))
    )
    near = join_null_safe(wanted, start, group, "inner").filter(F.col("_slice") >= F.col("_start"))
    dealt = in_ranges(near.drop("_slice", "_start"), group, ["ts", "seq"])
    place = [*group, "_range"]
    counts = sum_beside(dealt.groupBy(*place).agg(F.count("*").alias("n")), group, "n", "_later", later=True)
    newest = Window.partitionBy(*place).orderBy(F.desc("ts"), F.desc("seq"))
    tail = (
        join_null_safe(dealt, counts.filter(F.col("_later") < lines).drop("n"), place, "inner")
        .withColumn("_rank", F.row_number().over(newest) + F.col("_later"))
        .filter(F.col("_rank") <= lines)
        .drop("_later", "_rank")
    )
    size = F.octet_length("line").cast("bigint") + 1
    before = sum_beside(tail.groupBy(*place).agg(F.sum(size).alias("n")), group, "n", "_before").drop("n")
    oldest = Window.partitionBy(*place).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    told = join_null_safe(tail, before, place, "inner").withColumn("bytes", F.sum(size).over(oldest) + F.col("_before"))
    told = told.drop("_before", "_range")
    return told if byte_cap is None else told.filter(F.col("bytes") <= byte_cap)


def log_availability(requests: DataFrame, workspaces: DataFrame, pods: DataFrame) -> DataFrame:
    """Can the asked log be read? (namespace, workspace, container or null, previous) to a status code."""
    known = workspaces.select("namespace", F.col("name").alias("workspace"), "pod_name", F.lit(True).alias("ws_known"))
    found = pods.select("namespace", F.col("name").alias("pod_name"), F.col("containers"))
    rows = requests.join(known, ["namespace", "workspace"], "left").join(found, ["namespace", "pod_name"], "left")
    asked = F.coalesce("container", F.lit(C.MAIN_CONTAINER))
    # init containers may be read only when they are named
    target = F.coalesce(
        F.get(F.filter("containers", lambda c: (c["name"] == asked) & ~c["init"]), F.lit(0)),
        F.get(F.filter("containers", lambda c: (c["name"] == F.col("container")) & c["init"]), F.lit(0)),
    )
    regular = F.size(F.filter("containers", lambda c: ~c["init"]))
    rows = rows.withColumn("target", target)
    status = (
        F.when(F.col("ws_known").isNull(), F.lit("WORKSPACE_NOT_FOUND"))
        .when((F.coalesce("pod_name", F.lit("")) == "") | F.col("containers").isNull(), F.lit("POD_NOT_RUNNING"))
        .when(F.col("container").isNull() & (regular == 0), F.lit("CONTAINER_NOT_RUNNING"))
        .when(F.col("target").isNull(), F.lit("CONTAINER_NOT_FOUND"))
        .when(F.col("previous") & ~F.col("target.has_previous"), F.lit("PREVIOUS_NOT_FOUND"))
        .when(~F.col("previous") & F.col("target.waiting_reason").isNotNull(), F.lit("CONTAINER_NOT_RUNNING"))
        .otherwise(F.lit("AVAILABLE"))
    )
    return rows.select(*requests.columns, status.alias("status"))


def usage_status(requests: DataFrame, workspaces: DataFrame, pods: DataFrame, usage: DataFrame) -> DataFrame:
    """Does a usage request get numbers? A missing workspace differs from one that is not running.

    ``pods`` are the workspace's pods found by label (namespace, workspace, pod); a pod without any sample gets
    its spec only.
    """
    known = workspaces.select("namespace", F.col("name").alias("workspace"), F.lit(True).alias("ws_known"))
    sampled = usage.select("namespace", "pod").distinct().withColumn("sampled", F.lit(True))
    status = (
        F.when(F.col("ws_known").isNull(), F.lit("WORKSPACE_NOT_FOUND"))
        .when(F.col("pod").isNull(), F.lit("WORKSPACE_NOT_RUNNING"))
        .when(F.col("sampled").isNull(), F.lit("PENDING"))
        .otherwise(F.lit("AVAILABLE"))
    )
    return (
        requests.join(known, ["namespace", "workspace"], "left")
        .join(pods.select("namespace", "workspace", "pod"), ["namespace", "workspace"], "left")
        .join(sampled, ["namespace", "pod"], "left")
        .select(*requests.columns, "pod", status.alias("status"))
    )
