"""Streaming jobs.

Row filters and joins to static tables run as plain streaming queries. Jobs that keep a status by key run the batch
operators on each micro-batch and merge what it changes into a keyed table: re-running a batch after a failure gives the
same table, and a workspace holding a third of the rows is spread by the same ranges and partial aggregates as
in batch, instead of filling one stateful task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetloom.functions.columns import join_full_null_safe, join_null_safe
from fleetloom.operators import timeline as T
from fleetloom.operators.aggregates import option_usage
from fleetloom.operators.filters import relevant_event
from fleetloom.operators.joins import affected_kinds, workspace_uids
from fleetloom.operators.rules import evaluate_activity_rules, pause_decision
from fleetloom.session import cut_lineage, forget
from fleetloom.streaming.keyed import KeyedTable

WORKSPACE = T.WORKSPACE


class VersionedTable:
    """What each micro-batch has to tell, as one folder per batch id; a batch that is run again overwrites its own."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")

    def read(self, spark: SparkSession, version: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/v={version}")


def run_batches(
    stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Start ``handler`` on every micro-batch; by default process what is there and stop."""
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def append_rows(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def stream_warnings(events: DataFrame) -> DataFrame:
    """Warnings about pods and sets that were created or updated, as they arrive."""
    return relevant_event(events)


CHANGES = "source STRING, namespace STRING, name STRING, changes BIGINT, last_ms BIGINT, late BIGINT"


def change_rows(source: str, df: DataFrame, namespace: Column, name: Column, ts: Column) -> DataFrame:
    """Changes of one source as (source, namespace, name, ts_ms)."""
    return df.select(F.lit(source).alias("source"), namespace.alias("namespace"), name.alias("name"), F.unix_millis(ts).alias("ts_ms"))


def changed_objects(events: DataFrame, kinds: DataFrame, assets: DataFrame) -> DataFrame:
    """The three streams that touch workspaces as one: relevant events, kinds (name, changed_ts) and labelled stored
    objects (namespace, name, changed_ts)."""
    relevant = relevant_event(events).filter(F.col("involved_uid") != "")
    every = change_rows("event", relevant, F.col("namespace"), F.col("involved_uid"), F.col("last_ts"))
    every = every.unionByName(change_rows("kind", kinds, F.lit(""), F.col("name"), F.col("changed_ts")))
    return every.unionByName(change_rows("asset", assets, F.col("namespace"), F.col("name"), F.col("changed_ts")))


def impacted_workspaces(changed: DataFrame, workspaces: DataFrame, kinds: DataFrame) -> DataFrame:
    """(source, namespace, workspace): the workspaces that changed things (source, namespace, name) touch, each once a source.

    An event touches the owner of its uid, in its own namespace; a kind its workspaces; a stored object the workspaces of
    the kinds whose icon or logo lives in it.
    """
    by_source = lambda source: changed.filter(F.col("source") == source)
    owners = by_source("event").select("namespace", F.col("name").alias("uid")).join(workspace_uids(workspaces), ["namespace", "uid"])
    owners = owners.select(F.lit("event").alias("source"), "namespace", "workspace")
    touched = by_source("kind").select(F.lit("kind").alias("source"), F.col("name").alias("kind"))
    by_asset = affected_kinds(by_source("asset"), kinds).select(F.lit("asset").alias("source"), "kind")
    fleet = workspaces.select("kind", "namespace", F.col("name").alias("workspace"))
    of_kinds = touched.unionByName(by_asset).distinct().join(fleet, "kind").select("source", "namespace", "workspace")
    return owners.unionByName(of_kinds).distinct()


def changes_table(path: str, buckets: int = 16) -> KeyedTable:
    return KeyedTable(path, CHANGES, ["source", "namespace", "name"], buckets)


def keep_changes(
    table: KeyedTable, requests: VersionedTable | None = None, workspaces: DataFrame | None = None, kinds: DataFrame | None = None
) -> Callable[[DataFrame, int], None]:
    """Fold :func:`changed_objects` into one row per changed thing: how many changes, and when the newest was.

    Neither depends on how the changes are cut into batches or in which order they come; ``late`` counts those that came
    after a newer one of an earlier batch, and none is dropped. ``requests`` gets the workspaces that each batch touches,
    once a batch and source. A thing that changes all the time is one row, found by partial sums.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        # changes of one moment are counted first, so that a thing that changes all the time is not joined change by change
        batch = batch.groupBy("source", "namespace", "name", "ts_ms").agg(F.count(F.lit(1)).alias("n"))
        batch = cut_lineage(batch)
        known = table.like(batch, batch_id).withColumnRenamed("last_ms", "known_ms").withColumnRenamed("late", "known_late")
        rows = join_null_safe(batch, known, table.keys, "left").withColumn("known_changes", F.coalesce("changes", F.lit(0)))
        late = F.sum(F.when(F.col("ts_ms") < F.col("known_ms"), F.col("n")).otherwise(0))
        found = rows.groupBy(*table.keys).agg(
            (F.max("known_changes") + F.sum("n")).alias("changes"),
            F.greatest(F.max("ts_ms"), F.max("known_ms")).alias("last_ms"),
            (F.coalesce(F.max("known_late"), F.lit(0)) + late).alias("late"),
        )
        table.merge(found, batch_id)
        if requests is not None:
            requests.write(impacted_workspaces(batch, workspaces, kinds), batch_id)
        forget(batch)

    return handle


LAST_WARNING = "namespace STRING, uid STRING, event_id BIGINT, message STRING, last_ts TIMESTAMP"


def last_warning_table(path: str, buckets: int = 16) -> KeyedTable:
    return KeyedTable(path, LAST_WARNING, ["namespace", "uid"], buckets)


def keep_last_warning(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """Fold object events into the newest warning per uid, in any order of arrival."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        newest = F.max_by(F.struct("event_id", "message", "last_ts"), F.struct("last_ts", -F.col("event_id")))
        fold = lambda rows: rows.groupBy("namespace", "uid").agg(newest.alias("w")).select("namespace", "uid", "w.*")
        warnings = batch.filter((F.col("type") == "Warning") & (F.col("involved_uid") != ""))
        told = cut_lineage(fold(warnings.select("namespace", F.col("involved_uid").alias("uid"), "event_id", "message", "last_ts")))
        table.merge(fold(told.unionByName(table.like(told, batch_id))), batch_id)
        forget(told)

    return handle


FACTS = (
    "namespace STRING, workspace STRING, fact STRING, ts_ms BIGINT, seq BIGINT, state STRING, end_ms BIGINT, result STRING, "
    "activity_ms BIGINT"
)
STATUS = (
    "namespace STRING, workspace STRING, state STRING, state_ms BIGINT, state_seq BIGINT, last_running_ms BIGINT, "
    "last_activity_ms BIGINT, last_update_ms BIGINT, last_probe_start_ms BIGINT, last_probe_end_ms BIGINT, "
    "last_probe_result STRING, fresh BOOLEAN, late BIGINT"
)


def activity_facts(states: DataFrame, probes: DataFrame, tie: str = "event_id") -> DataFrame:
    """State changes and probes as rows of one journal; probe outputs are read here, once."""
    none = lambda kind: F.lit(None).cast(kind)
    changes = states.select(
        *WORKSPACE, F.lit("state").alias("fact"), "ts_ms", F.col("seq").cast("bigint").alias("seq"), "state",
        none("bigint").alias("end_ms"), none("string").alias("result"), none("bigint").alias("activity_ms"),
    )
    judged = T.probe_activity(probes).select(
        *WORKSPACE, F.lit("probe").alias("fact"), F.col("start_ms").alias("ts_ms"), F.col(tie).cast("bigint").alias("seq"),
        none("string").alias("state"), "end_ms", "result", "activity_ms",
    )
    return changes.unionByName(judged)


def fold_facts(status: DataFrame, facts: DataFrame) -> DataFrame:
    """New status of each workspace from its old one and facts that are all newer than what it was made of.

    Entering Running resets the activity, and probes begun before that do not count. Workspaces without a status start
    from nothing, so all facts of a workspace give its status from any state of affairs.
    """
    zero, states = F.lit(0).cast("bigint"), F.col("fact") == "state"
    last = status.filter(F.col("state").isNotNull()).select(
        *WORKSPACE, F.col("state_ms").alias("ts_ms"), F.col("state_seq").alias("seq"), "state", F.lit(True).alias("old")
    )
    every = last.unionByName(facts.filter(states).select(*WORKSPACE, "ts_ms", "seq", "state", F.lit(False).alias("old")))
    # one aggregate tells the newest state and when the last new run began
    entered = T.with_entered(every)
    newest = entered.groupBy(*WORKSPACE).agg(
        F.max_by(F.struct("state", "ts_ms", "seq"), F.struct("ts_ms", "seq")).alias("s"),
        F.max(F.when(F.col("entered") & ~F.col("old"), F.col("ts_ms"))).alias("entered_ms"),
    )
    base = join_full_null_safe(status.drop("state", "state_ms", "state_seq", "fresh"), newest, WORKSPACE)
    reset = F.col("entered_ms").isNotNull()

    def kept(column: str, otherwise: Column) -> Column:
        return F.when(reset, otherwise).otherwise(F.coalesce(column, otherwise))

    base = base.select(
        *WORKSPACE, F.col("s.state").alias("state"), F.col("s.ts_ms").alias("state_ms"), F.col("s.seq").alias("state_seq"),
        F.coalesce("entered_ms", "last_running_ms", zero).alias("last_running_ms"),
        kept("last_activity_ms", zero).alias("last_activity_ms"), kept("last_update_ms", zero).alias("last_update_ms"),
        *[kept(c, F.lit(None)).alias(c) for c in ("last_probe_start_ms", "last_probe_end_ms", "last_probe_result")],
        F.coalesce("late", zero).alias("late"),
    )
    began = base.select(*WORKSPACE, "last_running_ms")
    probes = join_null_safe(facts.filter(~states).withColumnRenamed("ts_ms", "start_ms"), began, WORKSPACE, "left")
    probes = probes.withColumn("last_running_ms", F.coalesce("last_running_ms", zero)).filter("start_ms >= last_running_ms")
    told = T.probe_facts(probes, ["start_ms", "seq"]).withColumnRenamed("last_running_ms", "run_ms")
    joined = join_full_null_safe(base, told, WORKSPACE)
    running = F.coalesce("last_running_ms", "run_ms", zero)
    result = F.coalesce("last_probe.result", "last_probe_result")
    folded = joined.select(
        *WORKSPACE, "state", "state_ms", "state_seq", running.alias("last_running_ms"),
        T.folded_activity(F.coalesce("last_activity_ms", zero), running).alias("last_activity_ms"),
        F.coalesce("updated_ms", "last_update_ms", zero).alias("last_update_ms"),
        F.coalesce("last_probe.start_ms", "last_probe_start_ms").alias("last_probe_start_ms"),
        F.coalesce("last_probe.end_ms", "last_probe_end_ms").alias("last_probe_end_ms"),
        result.alias("last_probe_result"),
        (F.col("last_probe.result").eqNullSafe("Success")).alias("fresh"), F.coalesce("late", zero).alias("late"),
    )
    folded.dealt = entered.dealt
    return folded


class ActivityTable:
    """The activity status of workspaces, with the journal of the facts it was made of."""

    def __init__(self, path: str, buckets: int = 16):
        self.status = KeyedTable(f"{path.rstrip('/')}/status", STATUS, WORKSPACE, buckets)
        self.journal = KeyedTable(f"{path.rstrip('/')}/journal", FACTS, WORKSPACE, buckets)

    def read(self, spark: SparkSession) -> DataFrame:
        return self.status.read(spark)


def late_workspaces(stored: DataFrame, facts: DataFrame) -> DataFrame:
    """Workspaces with facts not newer than those their status was made of, with the number of such facts.

    A state change is late behind a stored one or behind a probe, which it may part from its run; a probe behind a stored
    probe.
    """
    known = stored.select(*WORKSPACE, F.struct("state_ms", "state_seq").alias("seen"), "state", "last_probe_start_ms")
    rows = join_null_safe(facts.select(*WORKSPACE, "fact", "ts_ms", "seq"), known, WORKSPACE, "inner")
    behind_state = F.col("state").isNotNull() & (F.struct("ts_ms", "seq") <= F.col("seen"))
    behind_probe = F.coalesce(F.col("ts_ms") <= F.col("last_probe_start_ms"), F.lit(False))
    late = ((F.col("fact") == "state") & behind_state) | behind_probe
    return rows.filter(late).groupBy(*WORKSPACE).agg(F.count(F.lit(1)).alias("new_late"))


def keep_activity(
    table: ActivityTable,
    split: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    tie: str = "event_id",
    after: Callable[[DataFrame, int], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """Fold each micro-batch into the activity status. ``split`` gives its state changes and its probes, ``tie`` orders
    probes of equal start.

    Facts are added to the journal. Where they are newer than what a status was made of, they are folded into it. Where
    one is late, the status is withdrawn and made again from all facts of the workspace, so the status never depends on
    the order of arrival; only the buckets of such workspaces are read from the journal. ``late`` counts such facts, and
    ``fresh`` tells that the newest probe came with this batch. ``after`` gets the statuses that the batch has changed.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        states, probes = split(batch)
        facts = table.journal.append(activity_facts(states, probes, tie), batch_id)
        stored = table.status.like(facts, batch_id)
        known = table.status.manifest(spark, batch_id)["version"] >= 0
        late = cut_lineage(late_workspaces(stored, facts)) if known else None
        if late is None or late.isEmpty():
            found = fold_facts(stored, facts)
            dealt = found.dealt
        else:
            again = table.journal.like(late, batch_id + 1)
            found = fold_facts(_without(stored, late), _without(facts, late).unionByName(again))
            dealt = found.dealt
            counted = late.unionByName(_held_late(stored, late)).groupBy(*WORKSPACE).agg(F.sum("new_late").alias("new_late"))
            # of a status that was made again the newest probe may have come long ago
            arrived = facts.filter("fact = 'probe'").groupBy(*WORKSPACE).agg(F.max("ts_ms").alias("arrived_ms"))
            found = join_null_safe(join_null_safe(found, counted, WORKSPACE, "left"), arrived, WORKSPACE, "left")
            fresh = F.col("fresh") & F.coalesce(F.col("last_probe_start_ms") == F.col("arrived_ms"), F.lit(False))
            found = found.withColumn("late", F.coalesce("new_late", "late")).withColumn("fresh", fresh).drop("new_late", "arrived_ms")
        changed = cut_lineage(found)
        table.status.merge(changed, batch_id)
        if after is not None:
            after(changed, batch_id)
        forget(changed, dealt, *([late] if late is not None else []))

    return handle


def _without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return join_null_safe(rows, keys.select(*WORKSPACE, F.lit(True).alias("_there")), WORKSPACE, "left").filter("_there is null").drop("_there")


def _held_late(stored: DataFrame, late: DataFrame) -> DataFrame:
    return join_null_safe(late.select(*WORKSPACE), stored.select(*WORKSPACE, F.col("late").alias("new_late")), WORKSPACE, "inner")


DECISIONS = (
    "namespace STRING, name STRING, last_activity_ms BIGINT, eligible_after_ms BIGINT, eligible BOOLEAN, pause_now BOOLEAN, batch BIGINT"
)


def decisions_table(path: str, buckets: int = 16) -> KeyedTable:
    return KeyedTable(path, DECISIONS, ["namespace", "name"], buckets)


def decide_pauses(
    decisions: KeyedTable, workspaces: DataFrame, kinds: DataFrame, options: DataFrame, namespaces: DataFrame, rules
) -> Callable[[DataFrame, int], None]:
    """After each batch: the pause decision of every workspace whose status changed and whose newest probe is a success.

    The probe's end is the current time. ``eligible`` is what the rules say, ``pause_now`` holds only where the probe is
    fresh, so that a decision never rests on stale activity; ``batch`` tells which batch decided. A decision whose status
    was changed, or withdrawn by a late fact, is replaced; it is taken back where the newest probe is no success any more.
    """

    def handle(changed: DataFrame, batch_id: int) -> None:
        probed = changed.filter(F.col("last_probe_result") == "Success").drop("state_ms", "state_seq", "late")
        fixed = workspaces.select("namespace", F.col("name").alias("workspace"), "kind", "pod_id")
        probes = kinds.select(F.col("name").alias("kind"), F.col("probe").isNotNull().alias("has_probe"))
        rows = probed.join(fixed, WORKSPACE).join(probes, "kind").withColumnRenamed("workspace", "name")
        decided = evaluate_activity_rules(rows, options, namespaces, rules)
        judged = pause_decision(decided, F.col("last_probe_end_ms"), F.lit(True)).withColumn("eligible", F.col("pause_now"))
        out = judged.select(
            "namespace", "name", "last_activity_ms", "eligible_after_ms", "eligible",
            (F.col("eligible") & F.col("fresh")).alias("pause_now"), F.lit(batch_id).cast("bigint").alias("batch"),
        )
        decisions.merge(out, batch_id, gone=changed.select("namespace", F.col("workspace").alias("name")))

    return handle


def current_decisions(decisions: KeyedTable, spark: SparkSession) -> DataFrame:
    """All decisions; ``pause_now`` holds for those of the last batch only, as older probes are stale by now."""
    last = decisions.manifest(spark)["version"]
    return decisions.read(spark).withColumn("pause_now", F.col("pause_now") & (F.col("batch") == last))


LEVELS = "namespace STRING, workspace STRING, snapshot_id BIGINT, level STRING"


def levels_table(path: str, buckets: int = 16) -> KeyedTable:
    return KeyedTable(path, LEVELS, WORKSPACE, buckets)


def keep_escalations(levels: KeyedTable, found: VersionedTable) -> Callable[[DataFrame, int], None]:
    """Report rises of the activity level across snapshots; only the last level per workspace is kept.

    The first snapshot of all, which reports nothing, is told by the first batch and noted in the manifest.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = cut_lineage(batch.select("namespace", "workspace", "snapshot_id", "level"))
        first = levels.manifest(batch.sparkSession, batch_id)["notes"].get("first_snapshot")
        if first is None:
            first = batch.agg(F.min("snapshot_id")).first()[0]
        before = levels.like(batch, batch_id)
        every = before.withColumn("old", F.lit(True)).unionByName(batch.withColumn("old", F.lit(False)))
        rises = T.escalations(every, first, carry=["old"])
        found.write(rises.filter(~F.col("old")).drop("old"), batch_id)
        forget(rises.dealt)
        last = every.groupBy(*WORKSPACE).agg(F.max_by(F.struct("snapshot_id", "level"), "snapshot_id").alias("l"))
        levels.merge(last.select(*WORKSPACE, "l.snapshot_id", "l.level"), batch_id, {"first_snapshot": first})
        forget(batch)

    return handle


COUNTS = "kind STRING, option_type STRING, id STRING, workspaces BIGINT"


def counts_table(path: str, buckets: int = 16) -> KeyedTable:
    return KeyedTable(path, COUNTS, ["kind"], buckets)


def keep_usage_counts(counts: KeyedTable, current: Callable[[], DataFrame], options: DataFrame) -> Callable[[DataFrame, int], None]:
    """Recount the options of the kinds touched by a batch of workspace changes; other kinds keep their counts."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        touched = cut_lineage(batch.select("kind").distinct())
        workspaces = current().join(touched, "kind", "left_semi")
        recounted = option_usage(workspaces, options.join(touched, "kind", "left_semi"))
        counts.merge(recounted, batch_id, gone=touched)
        forget(touched)

    return handle


def all_versions(spark: SparkSession, table: VersionedTable, batches: int) -> DataFrame:
    """Every version as rows with its batch id."""
    return spark.read.option("basePath", table.path).parquet(
        *[f"{table.path}/v={version}" for version in range(batches)]
    ).withColumnRenamed("v", "batch_id")
