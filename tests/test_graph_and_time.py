"""Redirect graphs against a plain walk; ordered operators against global windows and case tables."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetloom.functions.chunked import in_ranges, with_previous
from fleetloom.operators import ordering as O
from fleetloom.operators import redirects as G
from fleetloom.operators import states as S
from fleetloom.operators import timeline as T

OPTION = (
    "kind string, option_type string, id string, display_name string, "
    "redirect struct<to:string,level:string,text:string>"
)


def options(spark, edges):
    data = [("k", "image", i, f"name {i}", None if to is None else (to, "Info", "t")) for i, to in edges.items()]
    return spark.createDataFrame(data, OPTION)


def walk(edges, start):
    """(end, steps, error kind, closer)"""
    seen, at, steps = {start}, start, 0
    while edges[at] is not None:
        to = edges[at]
        if to in seen:
            return None, steps, "circular", at
        if to not in edges:
            return at, steps, "missing", to
        seen.add(to)
        at, steps = to, steps + 1
    return at, steps, None, None


@pytest.mark.parametrize("seed, size", [(1, 1), (3, 60)])
def test_random_graphs(spark, seed, size):
    rng = random.Random(seed)
    ids = [f"o{i:03d}" for i in range(size)]
    edges = {i: rng.choice([None, "gone", *ids, *ids, *ids, *ids]) if size > 1 else i for i in ids}
    check_graph(spark, edges)


def test_long_chain_and_long_cycle(spark):
    chain = {f"c{i:03d}": f"c{i + 1:03d}" if i < 99 else None for i in range(100)}
    cycle = {f"r{i:03d}": f"r{(i + 1) % 37:03d}" for i in range(37)}
    tail = {f"t{i:03d}": f"t{i + 1:03d}" if i < 20 else "r005" for i in range(21)}
    check_graph(spark, {**chain, **cycle, **tail})


def check_graph(spark, edges):
    df = options(spark, edges)
    closure = G.close(df)
    expected = {i: walk(edges, i) for i in edges}
    got = {row["id"]: row for row in G.resolve_redirects(df.select(*G.NODE), df, closure).collect()}
    assert set(got) == set(edges)
    for i, (end, steps, error, other) in expected.items():
        if error is None:
            assert (got[i]["desired"], got[i]["steps"], got[i]["error"]) == (end, steps, None)
        elif error == "circular":
            assert got[i]["error"] == f'imageConfig with id "{other}" has a circular redirect'
        else:
            assert got[i]["error"] == f'imageConfig with id "{other}" not found, was redirected from "{end}"'
    on_cycle = {i for i in edges if edges[i] is not None and _returns(edges, i)}
    assert {row["id"] for row in G.redirect_cycles(closure).collect()} == on_cycle
    summary = {row["id"]: row for row in G.preview_summary(closure).collect()}
    for i, (end, steps, error, _) in expected.items():
        assert summary[i]["steps"] == steps + (error == "missing")
        assert summary[i]["cycle_detected"] == (error == "circular")
    path = {}
    for row in G.redirect_preview(df, closure).collect():
        path.setdefault(row["start"], {})[row["pos"]] = (row["source"], row["target"])
    for i, found in path.items():
        at = i
        for pos in range(len(found)):
            assert found[pos] == (at, edges[at])
            at = edges[at]
        assert len(found) == summary[i]["steps"]


def _returns(edges, start):
    at = edges[start]
    for _ in range(len(edges) + 1):
        if at == start:
            return True
        if at is None or at not in edges:
            return False
        at = edges[at]
    return False


def test_unknown_selection(spark):
    df = options(spark, {"a": None})
    asked = spark.createDataFrame([("k", "image", "zz")], "kind string, option_type string, id string")
    row = G.resolve_redirects(asked, df, G.close(df)).first()
    assert row["error"] == 'imageConfig with id "zz" not found'


def history(spark, seed, n=400):
    rng = random.Random(seed)
    data = [
        ("n", rng.choice(["hot"] * 6 + ["a", "b"]), rng.randint(0, 40) * 1000, i, rng.choice(["Running", "Error"]), rng.random() < 0.5)
        for i in range(n)
    ]
    return spark.createDataFrame(data, "namespace string, workspace string, ts_ms bigint, seq bigint, state string, paused boolean")


@pytest.fixture
def small_ranges(spark):
    """Ranges as they are dealt: Spark joins the tiny ones of a test into one otherwise."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("one_moment", [False, True])
def test_previous_equals_global_lag_and_a_hot_key_is_spread(spark, small_ranges, one_moment):
    df = history(spark, 700)
    if one_moment:
        df = df.withColumn("ts_ms", F.when(F.col("seq") % 50 > 0, F.lit(7).cast("bigint")))
    order = ["ts_ms", "seq"]
    hot = in_ranges(df, T.WORKSPACE, order).filter("workspace = 'hot'")
    assert hot.select("_range").distinct().count() > 1
    chunked = with_previous(df, T.WORKSPACE, order, ["state", "seq"])
    window = Window.partitionBy(*T.WORKSPACE).orderBy(*order)
    plain = df.withColumn("prev", F.lag(F.struct("state", "seq")).over(window))
    columns = ["workspace", "ts_ms", "seq", "prev"]
    assert rows(chunked, *columns) == rows(plain, *columns)


def test_row_order_does_not_matter(spark):
    df = history(spark, 5)
    shuffled = df.orderBy(F.rand(3)).repartition(7)
    assert rows(T.running_since(df)) == rows(T.running_since(shuffled))
    assert rows(T.pause_time(df)) == rows(T.pause_time(shuffled))


def test_pause_time(spark, small_ranges):
    data = [("a", 1, True), ("a", 2, True), ("b", 1, True), ("b", 2, False), ("c", 1, False), ("c", 2, True), ("c", 3, True)]
    df = spark.createDataFrame(
        [("n", w, ts, ts, "Paused", p) for w, ts, p in data],
        "namespace string, workspace string, ts_ms bigint, seq bigint, state string, paused boolean",
    )
    assert rows(T.pause_time(df), "workspace", "pause_ms") == [("a", 1), ("b", 0), ("c", 2)]


def test_escalations(spark, small_ranges):
    levels = {
        "up": ["none", "warning", "critical"],
        "jump": ["none", "critical", "critical"],
        "first": ["critical", "critical", "critical"],
        "fall": ["critical", "warning", "critical"],
        "gone": ["critical", None, "critical"],
    }
    data = [("n", w, i, level) for w, line in levels.items() for i, level in enumerate(line) if level]
    df = spark.createDataFrame(data, "namespace string, workspace string, snapshot_id bigint, level string")
    got = rows(T.escalations(df), "workspace", "snapshot_id", "from_level", "to_level")
    assert got == [
        ("fall", 2, "warning", "critical"),
        ("gone", 2, "none", "critical"),
        ("jump", 1, "none", "critical"),
        ("up", 1, "none", "warning"),
        ("up", 2, "warning", "critical"),
    ]


PROBE = "namespace string, workspace string, start_ms bigint, end_ms bigint, result string, output string"


@pytest.mark.parametrize(
    "output, result, activity",
    [
        ("", "Success", 9),
        ("  ", "Success", 9),
        ("{}", "Success", 9),
        ("null", "Success", 9),
        ('{"has_activity": true, "last_activity": "bad"}', "Success", 9),
        ('{"has_activity": false, "last_activity": "bad"}', "Success", None),
        ('{"last_activity": "1970-01-01T00:00:05Z"}', "Success", 5000),
        ('{"last_activity": "1970-01-01T01:00:05.5+01:00"}', "Success", 5500),
        ('{"last_activity": "noon"}', "Failure", None),
        ('{"has_activity": "yes"}', "Failure", None),
        ("not json", "Failure", None),
        ("[1]", "Failure", None),
    ],
)
def test_probe_output(spark, output, result, activity):
    df = spark.createDataFrame([("n", "w", 1, 9, "Success", output)], PROBE)
    row = T.probe_activity(df).first()
    assert (row["result"], row["activity_ms"]) == (result, activity)


@pytest.mark.parametrize(
    "outputs, running, expected",
    [
        ([('{"has_activity": true}', "Success")], 0, 10),
        ([('{"has_activity": false}', "Success")], 3, 3),
        ([('{"has_activity": false}', "Success")], 0, 0),
        ([("", "Failure")], 3, 0),
        ([('{"has_activity": true}', "Success"), ('{"last_activity": "1970-01-01T00:00:00.004Z"}', "Success")], 1, 4),
        ([('{"has_activity": true}', "Success"), ('{"has_activity": false}', "Success")], 1, 10),
        ([('{"last_activity": "1970-01-01T00:00:00Z"}', "Success"), ('{"has_activity": false}', "Success")], 2, 2),
    ],
)
def test_fold(spark, outputs, running, expected):
    data = [("n", "w", 5 + 10 * i, 10 + 10 * i, result, output) for i, (output, result) in enumerate(outputs)]
    runs = spark.createDataFrame([("n", "w", running)], "namespace string, workspace string, last_running_ms bigint")
    folded = T.fold_probes(T.probe_activity(spark.createDataFrame(data, PROBE)), runs, ["start_ms", "end_ms"]).first()
    assert folded["last_activity_ms"] == expected


def test_probe_due(spark):
    data = [(0, None, None), (1, 0, "Success"), (2, 9_000, "Success"), (3, 9_000, "Failure"), (4, 9_800, "Timeout")]
    df = spark.createDataFrame(data, "i int, start bigint, result string")
    due = T.probe_due(df, 10_000, F.lit(5), F.lit(1), F.col("start"), F.col("result"))
    assert rows(due, "i", "due", "remaining_ms") == [
        (0, True, 0),
        (1, True, 0),
        (2, False, 4000),
        (3, True, 0),
        (4, False, 800),
    ]


def test_log_tail_hot_container(spark):
    data = [("n", "w", "main", False, i, i, "x" * 9) for i in range(50)] + [("n", "v", "main", False, 1, 1, "y")]
    df = spark.createDataFrame(
        data, "namespace string, workspace string, container string, previous boolean, t bigint, seq bigint, line string"
    ).withColumn("ts", F.timestamp_seconds("t"))
    got = rows(T.log_tail(df, lines=5, byte_cap=30), "workspace", "seq", "bytes")
    assert got == [("v", 1, 2), ("w", 45, 10), ("w", 46, 20), ("w", 47, 30)]


@pytest.mark.parametrize("lines", [1, 40, 333, 10**6])
def test_log_tail_equals_ranks_over_whole_containers(spark, small_ranges, lines):
    rng = random.Random(lines)
    data = [
        (rng.choice(["n", None]), rng.choice(["hot"] * 5 + ["a"]), "main", False, rng.choice([None, 5, 5, 5, rng.randint(0, 10**7)]), i, "x" * rng.randint(0, 9))
        for i in range(700)
    ]
    df = spark.createDataFrame(
        data, "namespace string, workspace string, container string, previous boolean, t bigint, seq bigint, line string"
    ).withColumn("ts", F.timestamp_millis("t"))
    expected = []
    for key in {row[:2] for row in data}:
        last = sorted((row for row in data if row[:2] == key), key=lambda r: (r[4] is not None, r[4] or 0, r[5]))[-lines:]
        sizes = [sum(len(r[6]) + 1 for r in last[: i + 1]) for i in range(len(last))]
        expected += [(*key, r[5], size) for r, size in zip(last, sizes, strict=True)]
    got = rows(T.log_tail(df, lines=lines), "namespace", "workspace", "seq", "bytes")
    assert got == sorted(expected, key=repr)
    assert T.log_tail(df.filter("false"), lines=lines).count() == 0


def test_pages(spark):
    df = spark.range(95).withColumn("k", F.when(F.col("id") % 9 > 0, F.col("id") % 7)).repartition(5)
    order = [F.col("k").desc_nulls_last(), F.col("id").asc()]
    full = [row["id"] for row in df.orderBy(*order).collect()]
    for number in (0, 1, 4, 10, 99):
        at = min(max(number, 1), 10)
        assert [row["id"] for row in O.page(df, order, number).collect()] == full[(at - 1) * 10 : at * 10]
    assert [row["id"] for row in O.page(df, order, 2, 60).collect()] == full[60:]
    assert O.page(df.filter("id < 0"), order, 3).count() == 0
    ordered = O.row_order(df, "k", True, ("id",))
    assert [row["id"] for row in O.page(df, ordered, 1, 95).collect()] == [r["id"] for r in O.sort_workspaces(df, "k", True, ("id",)).collect()]


def test_chain_of_4096_and_plan_that_grows_by_its_logarithm(spark):
    edges = {f"c{i:04d}": f"c{i + 1:04d}" if i < 4095 else None for i in range(4096)} | {"a": "b", "b": None}
    df = options(spark, edges)
    closure = G.close(df)
    asked = spark.createDataFrame([("k", "image", "c0000"), ("k", "image", "a"), ("k", "image", "none")], "kind string, option_type string, id string")
    steps = G.redirect_steps(df, closure, asked)
    got = rows(steps, "start", "pos", "source", "target")
    assert got == sorted([("a", 0, "a", "b"), *[("c0000", i, f"c{i:04d}", f"c{i + 1:04d}") for i in range(4095)]], key=repr)
    plan = steps._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= len(closure.jumps) + 4 <= 18
    assert rows(G.redirect_preview(df, closure, asked), "start", "pos", "source", "target") == got


def test_stable_order(spark):
    previous = spark.createDataFrame([("b", 10), ("a", 20), ("gone", 30)], "id string, prev_rank bigint")
    current = spark.createDataFrame([("a", 1), ("b", 2), ("y", 4), ("x", 3)], "id string, key int")
    order = lambda resort: [r["id"] for r in O.stable_order(previous, current, "key", resort).orderBy("order_key").collect()]
    assert order(False) == ["b", "a", "x", "y"]
    assert order(True) == ["a", "b", "x", "y"]


def test_persisted_rank_keeps_the_order(spark):
    ordered = spark.range(50).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("id")).orderBy(F.desc("id"))
    kept = O.persist_rank(ordered).orderBy("prev_rank")
    assert [r["id"] for r in kept.collect()] == [r["id"] for r in ordered.collect()]


def test_census_of_owned_types_counts_and_names_the_first(spark):
    schema = "namespace string, owner string, name string, uid string, generation bigint, observed_generation bigint, update_revision string"
    sets = spark.createDataFrame([("n", "w", "s2", "u2", 1, 1, "r"), ("n", "w", "s1", "u1", 2, 2, "q"), ("n", "v", "s9", "u9", 1, 1, "r")], schema)
    helpers = [("n", "w", "Service", f"svc-{i}") for i in (3, 1, 2)] + [("n", "w", "ConfigMap", "c")] * 3 + [("n", "lone", "ServiceAccount", "a")]
    census = S.owned_census(sets, spark.createDataFrame(helpers, "namespace string, owner string, type string, name string"))
    got = {r["name"]: ({k: tuple(v) for k, v in r["owned"].asDict().items()}, r["set"] and r["set"]["uid"]) for r in census.collect()}
    none = (0, None)
    assert got["w"] == ({"ServiceAccount": none, "StatefulSet": (2, "s1"), "Service": (3, "svc-1"), "VirtualService": none}, "u1")
    assert got["v"][0]["StatefulSet"] == (1, "s9") and got["lone"] == ({**got["v"][0], "StatefulSet": none, "ServiceAccount": (1, "a")}, None)
    row = census.filter("name = 'w'").withColumns({c: F.lit(None).cast("string") for c in ("kind", "image_error", "pod_error", "port_error", "set_warning", "pod_warning")})
    pod = "struct<name:string,uid:string,owner_uid:string,revision:string,phase:string,deleting:boolean>"
    row = row.withColumns({"kind_known": F.lit(True), "paused": F.lit(False), "pod": F.lit(None).cast(pod)})
    condition, main = "struct<status:string,reason:string,message:string>", "struct<waiting_reason:string,waiting_message:string>"
    row = row.withColumns({"scheduled": F.lit(None).cast(condition), "ready": F.lit(None).cast(condition), "main": F.lit(None).cast(main)})
    row = row.withColumns({c: F.lit(None).cast("struct<message:string>") for c in ("set_warning", "pod_warning")})
    assert S.derive_state(row).first()["state_message"] == "Workspace owns multiple StatefulSets: s1 and 1 more"
    alone = row.withColumn("owned", F.col("owned").withField("StatefulSet", F.struct(F.lit(1).cast("bigint").alias("count"), F.lit("s1").alias("first"))))
    assert S.derive_state(alone).first()["state_message"] == "Workspace owns multiple Services: svc-1 and 2 more"


def test_a_warning_of_a_set_moves_with_it(spark):
    schema = "namespace string, owner string, name string, uid string, generation bigint, observed_generation bigint, update_revision string, warning struct<message:string>"
    sets = spark.createDataFrame([("n", "w", "s2", "u2", 1, 1, "r", ("late",)), ("n", "w", "s1", "u1", 1, 1, "r", ("first",)), ("n", "v", "s3", "u3", 1, 1, "r", None)], schema)
    assert rows(S.owned_census(sets), "name", "set.uid", "set.warning.message") == [("v", "u3", None), ("w", "u1", "first")]
