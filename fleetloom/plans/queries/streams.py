"""Streaming queries: the given tables are read as streams, processed as far as they go, and the result returned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.operators.filters import relevant_event
from fleetloom.plans.bindings import Fleet
from fleetloom.plans.queries.rules import _ACTIVITY
from fleetloom.plans.queries.states import _HISTORY, _PROBES
from fleetloom.plans.registry import query
from fleetloom.session import checkpoint_folder
from fleetloom.sources.snapshots import labelled_source
from fleetloom.streaming import jobs as X


class StreamFleet(Fleet):
    """A fleet whose named given tables are streams."""

    def __init__(self, base: Fleet, streamed: set[str], files_per_batch: int | None = None):
        super().__init__(base.spark, base.folder)
        self.base, self.streamed, self.files_per_batch = base, streamed, files_per_batch

    def given(self, name: str) -> DataFrame:
        static = self.base.given(name)
        if name not in self.streamed:
            return static
        reader = self.spark.readStream.schema(static.schema)
        if self.files_per_batch:
            reader = reader.option("maxFilesPerTrigger", self.files_per_batch)
        # a glob, because a stream may not be based on a single file
        return reader.parquet(f"{self.folder}/{name}.parquet*")


def _folder(t: Fleet) -> str:
    return f"{checkpoint_folder(t.spark).rstrip('/')}/fleetloom-stream/{uuid.uuid4().hex}"


def _finish(stream) -> int:
    """Wait for the end of an available-now query; the number of batches it ran."""
    stream.awaitTermination()
    progress = stream.lastProgress
    return 0 if progress is None else progress["batchId"] + 1


@query(
    "stream_warnings",
    """select event_id, namespace, involved_uid, reason from object_events where type = 'Warning'
      and involved_kind in ('Pod', 'StatefulSet') and change_op in ('create', 'update')""",
)
def _stream_warnings(t: Fleet) -> DataFrame:
    folder = _folder(t)
    events = X.stream_warnings(StreamFleet(t, {"events"}).object_events)
    columns = events.select("event_id", "namespace", "involved_uid", "reason")
    _finish(X.append_rows(columns, f"{folder}/out", f"{folder}/checkpoint"))
    return t.spark.read.schema(columns.schema).parquet(f"{folder}/out")


_EVENT_CHANGES = """select 'event' as source, namespace, involved_uid as name, last_ms as ts_ms from object_events
    where type = 'Warning' and involved_kind in ('Pod', 'StatefulSet') and change_op in ('create', 'update')
      and involved_uid <> ''"""
_KIND_CHANGES = """select 'kind', '', 'Brand#' || cast(user_id % 25 + 1 as varchar), epoch_us(ts) // 1000 from events
    where event_type = 'signup'"""
_ASSET_CHANGES = """select 'asset', namespace, name, cast(substr(key, 5) as bigint) * 1000 from assets where labelled"""
_ALL_CHANGES = f"c as ({_EVENT_CHANGES} union all {_KIND_CHANGES} union all {_ASSET_CHANGES})"


def _kind_changes(fleet: Fleet) -> DataFrame:
    signups = fleet.given("events").filter("event_type = 'signup'")
    return signups.select(
        F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("name"),
        F.col("ts").cast("timestamp").alias("changed_ts"),
    )


def _all_changes(fleet: Fleet) -> DataFrame:
    """Events, kinds and labelled stored objects; an object's key tells when it was stored."""
    stored = labelled_source(fleet.assets)
    stored = stored.select("namespace", "name", F.timestamp_seconds(F.substring("key", 5, 20).cast("bigint")).alias("changed_ts"))
    return X.changed_objects(fleet.object_events, _kind_changes(fleet), stored)


def _changed(t: Fleet, changes: DataFrame) -> DataFrame:
    """What the keyed table holds after the streams have run as far as they go."""
    folder = _folder(t)
    table = X.changes_table(f"{folder}/changes")
    _finish(X.run_batches(changes, X.keep_changes(table), f"{folder}/checkpoint"))
    return table.read(t.spark)


@query(
    "stream_impacted",
    """select distinct e.namespace, w.name as workspace from object_events e join workspaces w
      on w.namespace = e.namespace and e.involved_uid in (w.pod_uid, w.set_uid)
    where e.type = 'Warning' and e.involved_kind in ('Pod', 'StatefulSet') and e.change_op in ('create', 'update')
      and e.involved_uid <> ''""",
)
def _stream_impacted(t: Fleet) -> DataFrame:
    events = relevant_event(StreamFleet(t, {"events"}).object_events).filter(F.col("involved_uid") != "")
    changes = X.change_rows("event", events, F.col("namespace"), F.col("involved_uid"), F.col("last_ts"))
    return X.impacted_workspaces(_changed(t, changes), t.workspaces, t.kinds).select("namespace", "workspace")


@query(
    "stream_impacted_kinds",
    """select namespace, name as workspace, kind from workspaces where kind in (
      select 'Brand#' || cast(user_id % 25 + 1 as varchar) from events where event_type = 'signup')""",
)
def _stream_impacted_kinds(t: Fleet) -> DataFrame:
    kinds = _kind_changes(StreamFleet(t, {"events"}))
    changed = _changed(t, X.change_rows("kind", kinds, F.lit(""), F.col("name"), F.col("changed_ts")))
    fleet = t.workspaces.select("namespace", F.col("name").alias("workspace"), "kind")
    return changed.select(F.col("name").alias("kind")).join(fleet, "kind").select("namespace", "workspace", "kind")


@query(
    "stream_changes",
    f"""with {_ALL_CHANGES} select source, namespace, name, count(*) as changes, max(ts_ms) as last_ms, cast(0 as bigint) as late
    from c group by 1, 2, 3""",
)
def _stream_changes(t: Fleet) -> DataFrame:
    return _changed(t, _all_changes(StreamFleet(t, {"events", "documents", "pages"})))


@query(
    "stream_impacted_by_source",
    f"""with {_ALL_CHANGES}, d as (select distinct source, namespace, name from c), touched as (
      select 'kind' as source, name as kind from d where source = 'kind'
      union select 'asset', k.name from kinds k join d on d.source = 'asset' and (k.icon_url is null and k.icon_name = d.name
        or k.logo_name = d.name))
    select distinct 'event' as source, w.namespace, w.name as workspace from d join workspaces w
      on d.source = 'event' and w.namespace = d.namespace and d.name in (w.pod_uid, w.set_uid)
    union all select t.source, w.namespace, w.name from touched t join workspaces w on w.kind = t.kind""",
)
def _stream_impacted_by_source(t: Fleet) -> DataFrame:
    changed = _changed(t, _all_changes(StreamFleet(t, {"events", "documents", "pages"})))
    return X.impacted_workspaces(changed, t.workspaces, t.kinds)


@query(
    "stream_last_warning",
    "select namespace, uid, event_id, message, last_ms from last_warnings",
)
def _stream_last_warning(t: Fleet) -> DataFrame:
    folder = _folder(t)
    table = X.last_warning_table(f"{folder}/last")
    events = StreamFleet(t, {"events"}).object_events
    _finish(X.run_batches(events, X.keep_last_warning(table), f"{folder}/checkpoint"))
    return table.read(t.spark).withColumn("last_ms", F.unix_millis("last_ts")).drop("last_ts")


def _split(t: Fleet):
    """A micro-batch of the event table as state changes and probes, through the same views as in batch."""

    def split(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        class BatchFleet(Fleet):
            def given(self, name: str) -> DataFrame:
                return batch

        view = BatchFleet(t.spark, t.folder)
        return view.state_history, view.probes

    return split


_FOLD = f"""{_HISTORY}, {_PROBES}, cur as (select r.*, s.last_running_ms, s.state as ws_state
      from read r join since s on s.namespace = r.namespace and s.workspace = r.workspace),
    f as (select namespace, workspace, any_value(ws_state) as state, max(last_running_ms) as last_running_ms,
      max_by(activity_ms, (start_ms, event_id)) filter (where start_ms >= last_running_ms and result = 'Success'
        and activity_ms is not null) as told_ms,
      count(*) filter (where start_ms >= last_running_ms and result = 'Success' and activity_ms is null) as silent,
      max_by(end_ms, (start_ms, event_id)) filter (where start_ms >= last_running_ms and result = 'Success')
        as updated_ms,
      max_by(start_ms, (start_ms, event_id)) filter (where start_ms >= last_running_ms) as last_probe_start_ms,
      max_by(end_ms, (start_ms, event_id)) filter (where start_ms >= last_running_ms) as last_probe_end_ms,
      max_by(result, (start_ms, event_id)) filter (where start_ms >= last_running_ms) as last_probe_result
      from cur group by 1, 2),
    folded as (select namespace, workspace, state, last_running_ms, case when told_ms is not null then told_ms
      when silent > 0 and last_running_ms > 0 then last_running_ms else 0 end as last_activity_ms,
      coalesce(updated_ms, 0) as last_update_ms, last_probe_start_ms, last_probe_end_ms, last_probe_result from f)"""


@query(
    "stream_activity",
    f"""with {_FOLD} select namespace, workspace, state, last_running_ms, last_activity_ms, last_update_ms,
      last_probe_start_ms, last_probe_result, cast(0 as bigint) as late from folded""",
)
def _stream_activity(t: Fleet) -> DataFrame:
    folder = _folder(t)
    table = X.ActivityTable(f"{folder}/activity")
    events = StreamFleet(t, {"events"}).given("events")
    _finish(X.run_batches(events, X.keep_activity(table, _split(t)), f"{folder}/checkpoint"))
    return table.read(t.spark).drop("state_ms", "state_seq", "fresh", "last_probe_end_ms")


@query(
    "stream_pause",
    f"""with {_FOLD}, ctx as (select w.kind, w.kind_known, w.gpu_label, w.memory_label, n.tier, k.has_probe, f.*
      from folded f join ws_options w on w.namespace = f.namespace and w.name = f.workspace
      join kinds k on k.name = w.kind left join ns_labels n on n.name = w.namespace
      where f.last_probe_result = 'Success'),
    d as (select *, {_ACTIVITY} as idx from ctx),
    e as (select *, case idx when 1 then 1800 when 4 then 7200 when 5 then 3600 end as secs,
      case when idx = 1 then 300 else 0 end as min_run, has_probe and state = 'Running' and idx in (1, 4, 5) as pausing
      from d),
    a as (select *, case when pausing then case when last_activity_ms > 0 then last_activity_ms + secs * 1000 else 0 end
      end as after from e)
    select namespace, workspace as name, last_activity_ms, after as eligible_after_ms, coalesce(pausing
      and last_activity_ms > 0 and last_probe_end_ms >= after and (min_run = 0 or (last_running_ms > 0
      and last_probe_end_ms - last_running_ms >= min_run * 1000)), false) as pause_now from a""",
)
def _stream_pause(t: Fleet) -> DataFrame:
    folder = _folder(t)
    status, decisions = X.ActivityTable(f"{folder}/activity"), X.decisions_table(f"{folder}/decisions")
    decide = X.decide_pauses(decisions, t.workspaces, t.kinds, t.options, t.namespaces, t.activity_rules)
    events = StreamFleet(t, {"events"}).given("events")
    _finish(X.run_batches(events, X.keep_activity(status, _split(t), after=decide), f"{folder}/checkpoint"))
    return X.current_decisions(decisions, t.spark).drop("batch", "eligible")


@query(
    "stream_escalations",
    """with p as (select l.*, coalesce(b.level, 'none') as from_level from levels l left join levels b
      on b.namespace = l.namespace and b.workspace = l.workspace and b.snapshot_id = l.snapshot_id - 1)
    select namespace, workspace, snapshot_id, from_level, level as to_level from p
    where (from_level = 'none' and level <> 'none' or from_level = 'warning' and level = 'critical')
      and snapshot_id > (select min(snapshot_id) from levels)""",
)
def _stream_escalations(t: Fleet) -> DataFrame:
    folder = _folder(t)
    t.snapshot_levels.write.parquet(f"{folder}/levels")
    polls = t.spark.readStream.schema(t.snapshot_levels.schema).parquet(f"{folder}/levels")
    levels, found = X.levels_table(f"{folder}/last"), X.VersionedTable(f"{folder}/found")
    batches = _finish(X.run_batches(polls, X.keep_escalations(levels, found), f"{folder}/checkpoint"))
    return X.all_versions(t.spark, found, batches).drop("batch_id")


@query(
    "stream_usage_counts",
    """with c as (select kind, option_type, id, count(*) as n from (
      select kind, 'image' as option_type, image_id as id from workspaces
      union all select kind, 'pod', pod_id from workspaces) group by 1, 2, 3)
    select o.kind, o.option_type, o.id, coalesce(c.n, 0) as workspaces from options o
    left join c on c.kind = o.kind and c.option_type = o.option_type and c.id = o.id
    where o.kind in (select kind from workspaces)""",
)
def _stream_usage_counts(t: Fleet) -> DataFrame:
    folder = _folder(t)
    counts = X.counts_table(f"{folder}/counts")
    changes = StreamFleet(t, {"orders"}).workspaces.select("namespace", "name", "kind")
    _finish(X.run_batches(changes, X.keep_usage_counts(counts, lambda: t.workspaces, t.options), f"{folder}/checkpoint"))
    return counts.read(t.spark)
