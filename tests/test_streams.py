"""Streams over several files give what the batch operators give on the whole."""

from __future__ import annotations

import itertools
import time
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fleetloom.operators import timeline as T
from fleetloom.operators.aggregates import last_warning
from fleetloom.plans.bindings import Fleet
from fleetloom.plans.queries.streams import StreamFleet, _finish, _split
from fleetloom.sources.files import names
from fleetloom.streaming import jobs as X
from fleetloom.streaming.keyed import KeyedTable

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="given tables are not here")


@pytest.fixture()
def fleets(spark, tmp_path):
    base = Fleet(spark, FOLDER)
    events = base.given("events")
    bounds = [0, 137, 138, 500, 1000]
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = events.filter((F.col("event_id") >= low) & (F.col("event_id") < high))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        time.sleep(1.1)  # files are taken in order of their time stamp

    class Split(Fleet):
        def given(self, name):
            return events if name == "events" else base.given(name)

    split = Split(spark, str(tmp_path))
    return split, StreamFleet(split, {"events"}, files_per_batch=1)


def _parts(spark, events, bounds):
    return [events.filter((F.col("event_id") >= low) & (F.col("event_id") < high)) for low, high in itertools.pairwise(bounds)]


def _twin(batch, spark):
    running = T.running_since(batch.state_history)
    return running, T.fold_probes(T.probe_activity(batch.probes), running, ["start_ms", "event_id"])


FOLDED = ["namespace", "workspace", "last_running_ms", "last_activity_ms", "last_update_ms", "last_probe_start_ms"]


def test_activity(spark, fleets, tmp_path):
    batch, stream = fleets
    table = X.ActivityTable(str(tmp_path / "activity"), buckets=4)
    batches = _finish(X.run_batches(stream.given("events"), X.keep_activity(table, _split(batch)), str(tmp_path / "cp")))
    assert batches == 4
    running, folded = _twin(batch, spark)
    assert rows(table.read(spark), *FOLDED) == rows(folded, *FOLDED)
    assert rows(table.read(spark), "workspace", "state") == rows(running, "workspace", "state")


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_activity_and_pauses_in_any_order_of_batches(spark, order, tmp_path):
    base = Fleet(spark, FOLDER)
    parts = _parts(spark, base.given("events"), [0, 300, 420, 1000])
    table, decisions = X.ActivityTable(str(tmp_path / "activity"), buckets=4), X.decisions_table(str(tmp_path / "d"), buckets=4)
    fixed = (base.workspaces, base.kinds, base.options, base.namespaces, base.activity_rules)
    handle = X.keep_activity(table, _split(base), after=X.decide_pauses(decisions, *fixed))
    for batch_id, part in enumerate(order):
        handle(parts[part], batch_id)
    handle(parts[order[-1]], 2)  # a batch that is run again
    running, folded = _twin(base, spark)
    assert rows(table.read(spark), *FOLDED) == rows(folded, *FOLDED)
    assert rows(table.read(spark), "workspace", "state") == rows(running, "workspace", "state")
    late = table.read(spark).agg(F.sum("late")).first()[0]
    assert (late > 0) == (order != (0, 1, 2))
    whole = X.decisions_table(str(tmp_path / "whole"), buckets=4)
    X.decide_pauses(whole, *fixed)(table.read(spark).withColumn("fresh", F.lit(True)), 0)
    columns = ["namespace", "name", "last_activity_ms", "eligible_after_ms", "eligible"]
    assert rows(decisions.read(spark), *columns) == rows(whole.read(spark), *columns)
    now = X.current_decisions(decisions, spark)
    assert now.filter("pause_now and (batch < 2 or not eligible)").isEmpty()


def _facts(spark, *given):
    """Facts (workspace, state or None, ts, seq or (end, result))."""
    found = [("n", w, "state", ts, seq, state, None, None, None) for w, state, ts, seq in given if state]
    found += [("n", w, "probe", ts, ts, None, ts + 10, result, ts + 10 if result == "Success" else None) for w, state, ts, result in given if not state]
    return spark.createDataFrame(found, X.FACTS)


def _kept(spark, table, batches):
    """The table after batches of facts, which are given as they are."""
    empty = spark.createDataFrame([], "namespace string, workspace string, ts_ms bigint, seq bigint, state string")
    probes = spark.createDataFrame([], "namespace string, workspace string, start_ms bigint, end_ms bigint, result string, output string, event_id bigint")
    for batch_id, facts in enumerate(batches):
        states = facts.filter("fact = 'state'").select(empty.columns)
        judged = facts.filter("fact = 'probe'").select("namespace", "workspace", F.col("ts_ms").alias("start_ms"), "end_ms", "result", F.lit("").alias("output"), F.col("seq").alias("event_id"))
        handle = X.keep_activity(table, lambda _, s=states, p=judged: (empty.unionByName(s), probes.unionByName(p)))
        handle(empty, batch_id)
    return table.read(spark)


def test_late_facts_withdraw_what_they_change(spark, tmp_path):
    columns = ["workspace", "state", "last_running_ms", "last_activity_ms", "last_probe_start_ms", "fresh", "late"]
    runs = [("w", "Running", 100, 1), ("w", None, 120, "Success"), ("w", "Running", 200, 2)]
    # a late pause parts the run in two: the probe was of the first one
    got = _kept(spark, X.ActivityTable(str(tmp_path / "a"), 4), [_facts(spark, *runs), _facts(spark, ("w", "Paused", 150, 3))])
    assert rows(got, *columns) == [("w", "Running", 200, 0, None, False, 1)]
    # a late start of the run brings back a probe that did not count
    given = [_facts(spark, ("w", "Paused", 50, 1), ("w", "Running", 200, 2), ("w", None, 150, "Success")), _facts(spark, ("w", "Running", 140, 3))]
    got = _kept(spark, X.ActivityTable(str(tmp_path / "b"), 4), given)
    assert rows(got, *columns) == [("w", "Running", 140, 160, 150, False, 1)]
    # a late probe changes nothing that a newer one told, and is counted
    given = [_facts(spark, ("w", None, 100, "Success")), _facts(spark, ("w", None, 50, "Success"), ("v", None, 10, "Success"))]
    got = _kept(spark, X.ActivityTable(str(tmp_path / "c"), 4), given)
    assert rows(got, *columns) == [("v", None, 0, 20, 10, True, 0), ("w", None, 0, 110, 100, False, 1)]


def test_a_decision_is_taken_back_when_its_probe_is_no_success_any_more(spark, tmp_path):
    base = Fleet(spark, FOLDER)
    ws = base.workspaces.join(base.kinds.select(F.col("name").alias("kind")), "kind", "left_semi").first()
    decisions = X.decisions_table(str(tmp_path / "d"), 4)
    decide = X.decide_pauses(decisions, base.workspaces, base.kinds, base.options, base.namespaces, base.activity_rules)
    status = lambda result: spark.createDataFrame(
        [(ws["namespace"], ws["name"], "Running", 1, 1, 1, 5, 5, 6, 7, result, True, 0)], X.STATUS
    )
    decide(status("Success"), 0)
    assert decisions.read(spark).count() == 1
    decide(status("Failure"), 1)
    assert decisions.read(spark).count() == 0


def test_an_empty_stream_has_a_first_version(spark, tmp_path):
    for table in (X.ActivityTable(str(tmp_path / "a")), X.changes_table(str(tmp_path / "b")), X.counts_table(str(tmp_path / "c"))):
        assert table.read(spark).count() == 0


CHANGE = "source string, namespace string, name string, ts_ms bigint"


def test_changes_do_not_depend_on_batches(spark, tmp_path):
    given = [("event", "n", f"u{i % 3}", 100 * i) for i in range(12)] + [("kind", "", "k", 7), ("kind", "", "k", 7), ("asset", "a", None, 3)]
    whole = spark.createDataFrame(given, CHANGE)
    expected = rows(whole.groupBy("source", "namespace", "name").agg(F.count("*"), F.max("ts_ms")))
    for name, cut in {"one": [given], "three": [given[8:], given[:4], given[4:8]], "rows": [[r] for r in given[::-1][:6]] + [given[:9]]}.items():
        table, requests = X.changes_table(str(tmp_path / name), 4), X.VersionedTable(str(tmp_path / f"r-{name}"))
        workspaces = spark.createDataFrame([("n", "w0", "k", "u0", "s0"), ("n", "w1", "other", "u1", "")], "namespace string, name string, kind string, pod_uid string, set_uid string")
        kinds = Fleet(spark, FOLDER).kinds
        handle = X.keep_changes(table, requests, workspaces, kinds)
        for batch_id, part in enumerate(cut):
            handle(spark.createDataFrame(part, CHANGE), batch_id)
        assert rows(table.read(spark), "source", "namespace", "name", "changes", "last_ms") == expected
        assert (table.read(spark).agg(F.sum("late")).first()[0] > 0) == (name != "one")
    told = rows(requests.read(spark, len(cut) - 1))
    assert told == [("event", "n", "w0"), ("event", "n", "w1")]


def test_a_batch_reads_and_writes_the_buckets_of_its_keys_only(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), "k BIGINT, v BIGINT", ["k"], buckets=8, merge_at=3, history=2)
    table.merge(spark.range(100).selectExpr("id as k", "0 as v"), 0)
    first = table.manifest(spark)["buckets"]
    table.merge(spark.createDataFrame([(5, 1)], "k bigint, v bigint"), 1)
    second = table.manifest(spark)["buckets"]
    assert sum(first[b] != second[b] for b in first) == 1
    assert rows(table.read(spark)) == sorted([(k, int(k == 5)) for k in range(100)], key=repr)
    assert rows(table.read(spark, 0)) == sorted([(k, 0) for k in range(100)], key=repr)
    table.merge(spark.createDataFrame([(5, 2)], "k bigint, v bigint"), 1)  # run again, with another outcome
    assert rows(table.read(spark).filter("k = 5")) == [(5, 2)]
    table.merge(spark.createDataFrame([], "k bigint, v bigint"), 2, gone=spark.range(0, 99).withColumnRenamed("id", "k"))
    assert rows(table.read(spark)) == [(99, 0)]
    log = KeyedTable(str(tmp_path / "log"), "k BIGINT, v BIGINT", ["k"], buckets=2, merge_at=3, history=2)
    for version in range(9):
        log.append(spark.createDataFrame([(version % 2, version), (None, version)], "k bigint, v bigint"), version)
    assert rows(log.read(spark)) == sorted([(v % 2, v) for v in range(9)] + [(None, v) for v in range(9)], key=repr)
    assert rows(log.like(spark.createDataFrame([(None,)], "k bigint"))) == sorted([(None, v) for v in range(9)], key=repr)
    assert max(len(f) for f in log.manifest(spark)["buckets"].values()) <= 4
    assert len(names(spark, f"{log.path}/manifests")) <= 5
    assert rows(log.written(spark, 8)) == sorted([(0, 8), (None, 8)], key=repr)


def test_usage_counts_keep_other_kinds(spark, tmp_path):
    workspaces = spark.createDataFrame(
        [("n", "a", "k1", "i", "p"), ("n", "b", "k2", "i", "p"), ("n", "c", "k2", "i", "p")],
        "namespace string, name string, kind string, image_id string, pod_id string",
    )
    options = spark.createDataFrame(
        [("k1", "image", "i"), ("k2", "image", "i"), ("k3", "image", "i")], "kind string, option_type string, id string"
    )
    counts = X.counts_table(str(tmp_path / "counts"), 4)
    handle = X.keep_usage_counts(counts, lambda: workspaces, options)
    for batch_id, kind in enumerate(("k1", "k2", "k1")):
        handle(spark.createDataFrame([(kind,)], "kind string"), batch_id)
    assert rows(counts.read(spark), "kind", "workspaces") == [("k1", 1), ("k2", 2)]


def test_last_warning(spark, fleets, tmp_path):
    batch, stream = fleets
    table = X.last_warning_table(str(tmp_path / "last"), 4)
    assert _finish(X.run_batches(stream.object_events, X.keep_last_warning(table), str(tmp_path / "cp"))) == 4
    columns = ["namespace", "uid", "event_id", "message"]
    assert rows(table.read(spark), *columns) == rows(last_warning(batch.object_events), *columns)


def test_escalations(spark, fleets, tmp_path):
    batch, _ = fleets
    levels = batch.snapshot_levels
    for low, high in ((0, 473400), (473400, 473500), (473500, 10**9)):
        part = levels.filter((F.col("snapshot_id") >= low) & (F.col("snapshot_id") < high))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "levels"))
        time.sleep(1.1)
    polls = spark.readStream.schema(levels.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "levels"))
    kept, found = X.levels_table(str(tmp_path / "kept"), 4), X.VersionedTable(str(tmp_path / "found"))
    batches = _finish(X.run_batches(polls, X.keep_escalations(kept, found), str(tmp_path / "cp")))
    assert batches == 3
    got = X.all_versions(spark, found, batches).drop("batch_id")
    assert rows(got) == rows(T.escalations(levels))
