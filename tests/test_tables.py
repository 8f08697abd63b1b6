"""Sources, diffs, joins under skew, and plan shapes."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from fleetloom.operators import aggregates as A
from fleetloom.operators import diffs as D
from fleetloom.operators.filters import relevant_event
from fleetloom.sources import snapshots as S
from fleetloom.sources.logs import CONTAINER, prefixed, read_logs, stream_logs, unprefixed
from fleetloom.sources.usage import read_usage

FOLDER = "/root/testdata/sf0.001"


def test_bad_json_is_counted_not_lost(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"name": "a", "labels": {"t": "x"}}\nnot json\n{"name": "b"}\n')
    df = S.load_snapshot(spark, "namespaces", str(tmp_path), "json").cache()
    assert df.count() == 3
    assert df.filter(F.col(S.CORRUPT).isNotNull()).count() == 1


def test_read_logs_and_usage(spark, tmp_path):
    folder = tmp_path / "logs" / "namespace=n" / "workspace=w" / "container=main"
    folder.mkdir(parents=True)
    (folder / "a.log").write_text("2024-01-01T00:00:01Z [INFO] one two\nno time here\n")
    got = rows(read_logs(spark, str(tmp_path / "logs")), "namespace", "workspace", "container", F.unix_seconds("ts"), "line")
    assert got == [
        ("n", "w", "main", 1704067201, "[INFO] one two"),
        ("n", "w", "main", None, "no time here"),
    ]
    (tmp_path / "u").mkdir()
    report = {"namespace": "n", "pod": "p", "ts": "2024-01-01T00:00:00Z", "containers": [{"name": "main", "cpu": "50m", "memory": "64Mi"}]}
    (tmp_path / "u" / "r.json").write_text(json.dumps(report))
    assert rows(read_usage(spark, str(tmp_path / "u")), "container", "cpu", "memory") == [("main", "50m", "64Mi")]


@pytest.mark.parametrize("folders", [["namespace"], []])
def test_logs_of_many_containers_share_files(spark, tmp_path, folders):
    path = str(tmp_path / "logs")
    data = [("n", f"w{i}", c, f"2024-01-01T00:00:01Z [a/b] {i}") for i in range(300) for c in ("main", "proxy")]
    data += [("n", "w1", "main", "no time"), ("n", "w1", "main", None), ("n", None, "main", "2024-01-01T00:00:01Z  x ")]
    lines = spark.createDataFrame(data, "namespace string, workspace string, container string, value string").coalesce(2)
    keys = [key for key in CONTAINER if key not in folders]
    prefixed(lines, keys).write.partitionBy(*folders).text(path)
    assert len(list((tmp_path / "logs").rglob("*.txt"))) == 2
    expected = [("n", f"w{i}", c, 1704067201, f"[a/b] {i}") for i in range(300) for c in ("main", "proxy")]
    expected += [("n", "w1", "main", None, "no time"), ("n", "w1", "main", None, ""), ("n", None, "main", 1704067201, " x ")]
    read = read_logs(spark, path, folders)
    assert rows(read, *CONTAINER, F.unix_seconds("ts"), "line") == sorted(expected, key=repr)
    stream = stream_logs(spark, path, folders)
    assert stream.isStreaming and stream.schema == read.schema


def test_only_whole_prefixes_are_taken_off(spark):
    odd = ["[n/w/c]", "[n/w/c] ", "[n/w] x", "[n/w/c/d] x", "[n /w/c] x", "[n]/w/c] x", "n/w/c] x", "[n/w/c]x y", "[//] x", " [n/w/c] x", "", None]
    lines = spark.createDataFrame([(value,) for value in odd], "value string")
    got = [tuple(row) for row in unprefixed(lines, CONTAINER).select(*CONTAINER, "value").collect()]
    expected = [(None, None, None, value) for value in odd]
    expected[1], expected[8] = ("n", "w", "c", ""), (None, None, None, "x")
    assert got == expected


@pytest.mark.parametrize("name", ["read_logs", "stream_logs"])
def test_log_files_do_not_grow_with_namespaces(spark, name, tmp_path, monkeypatch):
    from fleetloom.plans.queries import scans

    documents = [(i, f"one {i}\r\nb\n") for i in range(100)] + [(None, "x"), (100, None)]
    spark.createDataFrame(documents, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    turns = [(i, 1, "user" if i % 2 else "assistant", "a\n\rb") for i in range(100)] + [(3, 2, "user", None)]
    schema = "conv_id bigint, turn bigint, role string, text string"
    spark.createDataFrame(turns, schema).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(scans, "_folder", lambda t, made=[]: made.append(0) or str(tmp_path / f"f{len(made)}"))
    got = entry_module.queries()[name](spark, str(tmp_path))
    assert got.count() == 100 * 3 + 1 + 101
    assert got.select("namespace").distinct().count() == 27
    assert rows(got.filter("workspace = 'ws-7'"), "namespace", "container", "ts_ms", "line") == sorted(
        [("NATION_7", "main", 1704067200000, "one 7 "), ("NATION_7", "main", 1704067201000, "b"), ("NATION_7", "main", 1704067202000, "")]
        + [("NATION_7", "main", 1704067260000, "a b")],
        key=repr,
    )
    assert len(list(tmp_path.rglob("*.txt"))) <= 2


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="given tables are not here")
@pytest.mark.parametrize("name", ["read_logs", "stream_logs"])
def test_log_queries_write_few_files(spark, name, tmp_path, monkeypatch):
    from fleetloom.plans.queries import scans

    monkeypatch.setattr(scans, "_folder", lambda t, made=[]: made.append(0) or str(tmp_path / f"f{len(made)}"))
    assert entry_module.queries()[name](spark, FOLDER).select("workspace").distinct().count() > 50
    assert len(list(tmp_path.rglob("*.txt"))) < 26 * 16


def test_only_changes_are_written(spark, tmp_path):
    schema = "namespace string, name string, v string, m map<string,string>"
    old = spark.createDataFrame([("n", "a", "1", {"x": "1", "y": "2"}), ("n", "b", None, None), ("n", "c", "1", {})], schema)
    new = spark.createDataFrame(
        [("n", "a", "1", {"y": "2", "x": "1"}), ("n", "b", None, None), ("n", "c", "2", {}), ("n", "d", "1", {})], schema
    )
    S.write_snapshot(new, old, str(tmp_path / "out"), ["namespace", "name"])
    assert rows(spark.read.parquet(str(tmp_path / "out")), "name") == [("c",), ("d",)]


def test_events_generic_and_delete_are_dropped(spark):
    data = [("Warning", "Pod", op) for op in ("create", "update", "delete", "generic")] + [("Warning", "Node", "create"), ("Normal", "Pod", "create")]
    df = spark.createDataFrame(data, "type string, involved_kind string, change_op string")
    assert rows(relevant_event(df), "change_op") == [("create",), ("update",)]


def test_last_warning_ties_and_namespaces(spark):
    data = [(2, "n", "u", "Warning", 5), (1, "n", "u", "Warning", 5), (3, "n", "u", "Normal", 9), (4, "m", "u", "Warning", 1)]
    df = spark.createDataFrame(data, "event_id bigint, namespace string, involved_uid string, type string, t bigint").select(
        "*", F.timestamp_seconds("t").alias("last_ts"), F.lit("r").alias("reason"), F.lit("m").alias("message")
    )
    assert rows(A.last_warning(df), "namespace", "event_id", "warnings") == [("m", 4, 1), ("n", 1, 2)]


PAIR = "namespace string, owner string, role string, name string, labels map<string,string>, owned_keys array<string>"


def test_map_merge_and_replace(spark):
    desired = spark.createDataFrame([("n", "o", "r", "d", {"a": "1", "b": "2", "e": ""}, [])], PAIR)
    observed = spark.createDataFrame([("n", "o", "r", "x", {"b": "9", "c": "3", "d": "4"}, ["c"])], PAIR)
    merged = dict(rows(D.map_drift_merge(desired, observed, "labels"), "key", "action"))
    assert merged == {"a": "add", "b": "change", "c": "remove", "d": "keep", "e": "keep"}
    replaced = {key for (key,) in rows(D.map_drift_replace(desired, observed, "labels"), "key")}
    assert replaced == {"a", "b", "c", "d"}


def test_reconcile_plan_with_crowded_key(spark):
    desired = spark.createDataFrame([("n", "o", "r", "d", {}, []), ("n", "o", "new", "d2", {}, [])], PAIR)
    crowd = [("n", "o", "r", f"x{i:03d}", {}, []) for i in range(200)] + [("n", "o", "old", "y", {}, [])]
    plan = D.reconcile_plan(desired, spark.createDataFrame(crowd, PAIR), ["labels"], [])
    counts = dict(rows(plan.groupBy("action").count()))
    assert counts == {"keep": 1, "create": 1, "delete": 200}


def test_option_usage_under_skew(spark):
    workspaces = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("kind"),
        F.lit("i").alias("image_id"),
        F.lit("gone").alias("pod_id"),
    )
    options = spark.createDataFrame([("hot", "image", "i"), ("hot", "pod", "p"), ("none", "pod", "p")], "kind string, option_type string, id string")
    assert rows(A.option_usage(workspaces, options)) == [("hot", "image", "i", 1000), ("hot", "pod", "p", 0), ("none", "pod", "p", 0)]


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas")


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="given tables are not here")
@pytest.mark.parametrize(
    "name",
    [
        "option_usage",
        "usage_summary",
        "workspace_view",
        "service_urls",
        "effective_mounts",
        "dropped_mounts",
        "event_owner",
        "mount_blocked",
        "evaluate_filter_rules",
        "match_rules",
        "list_option_values",
        "admit_create",
        "admit_update",
        "pause_decision",
        "claim_audit",
        "mount_path_audit",
        "reconcile_plan",
        "membership_diff",
        "running_since",
        "fold_probes",
        "escalations",
        "log_tail",
        "derive_state",
    ],
)
def test_plans_have_no_cross_joins_python_or_global_windows(spark, name):
    df = entry_module.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]
    # a window without a partition key gathers everything in one task
    assert "Exchange SinglePartition" not in plan


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="given tables are not here")
def test_filters_and_columns_reach_the_scan(spark):
    from fleetloom.plans.bindings import Fleet

    t = Fleet(spark, FOLDER)
    plan = t.workspaces.filter("state = 'Running'").select("name")._jdf.queryExecution().executedPlan().toString()
    assert "o_comment" not in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderpriority:string>" in plan
    written = S.warning_events(spark.read.schema("type string, message string").parquet(f"{FOLDER}/events.parquet"))
    assert "EqualTo(type,Warning)" in written._jdf.queryExecution().executedPlan().toString()
