"""Rule engine: null semantics, first match, error order, eligibility, agreement of both forms."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fleetloom.constants import SCOPE_IMAGE, SCOPE_KIND, SCOPE_POD
from fleetloom.functions import labels as L
from fleetloom.operators import rules as R

TARGETS = (
    "kind string, id string, scope string, target_labels map<string,string>, namespace_labels map<string,string>, "
    "image_labels map<string,string>, pod_labels map<string,string>"
)


def selector(match=None, *exprs):
    return L.Selector(match or {}, tuple(exprs))


def need(key, op, *values):
    return L.Requirement(key, op, tuple(values))


@pytest.mark.parametrize(
    "chosen, absent, empty, present",
    [
        (selector(), True, True, True),
        (selector({"k": "a"}), False, False, True),
        (selector({"k": "b"}), False, False, False),
        (selector(None, need("k", "In", "a", "b")), False, False, True),
        (selector(None, need("k", "NotIn", "a")), True, True, False),
        (selector(None, need("k", "NotIn", "b")), True, True, True),
        (selector(None, need("k", "Exists")), False, False, True),
        (selector(None, need("k", "DoesNotExist")), True, True, False),
    ],
)
def test_selector_null_semantics(spark, chosen, absent, empty, present):
    df = spark.createDataFrame([(0, None), (1, {}), (2, {"k": "a"})], "i int, labels map<string,string>")
    labels = F.col("labels")
    rule = spark.range(1).select(R._conditions_literal((R.Condition("pod", chosen),))[0].alias("c"))
    joined = df.join(rule, F.col("i") >= 0)
    stored = L.stored_selector_matches(labels, F.col("c.match_labels"), F.col("c.match_exprs"))
    got = rows(
        joined.select("i", L.selector_matches(labels, chosen), L.selector_matches_ctx(labels, chosen), stored)
    )
    assert [row[1] for row in got] == [absent, empty, present]
    assert [row[2] for row in got] == [False, empty, present]
    assert [row[3] for row in got] == [absent, empty, present]


@pytest.mark.parametrize(
    "chosen, valid",
    [
        (selector(None, need("k", "In", "a")), True),
        (selector(None, need("k", "In")), False),
        (selector(None, need("k", "Exists", "a")), False),
        (selector(None, need("k", "Near", "a")), False),
        (selector({"bad key": "a"}), False),
        (selector({"example.org/k": "a"}), True),
        (selector({"k": "not valid!"}), False),
    ],
)
def test_selector_validity(spark, chosen, valid):
    c = R._conditions_literal((R.Condition("pod", chosen),))[0]
    got = spark.range(1).select(L.stored_selector_valid(c["match_labels"], c["match_exprs"])).first()[0]
    assert got is valid


def effects(spark, rules, targets, stored=False):
    df = spark.createDataFrame(targets, TARGETS)
    used = rules
    if stored:
        kinds = spark.createDataFrame([("k1",), ("k2",)], "name string")
        used = R.filter_rule_table(kinds, rules)
    out = R.evaluate_filter_rules(df, used)
    return rows(out, "kind", "id", "scope", "ui_hide", "api_hide", "deny", "deny_message")


def test_first_match_wins_and_scope_is_respected(spark):
    rules = [
        R.FilterRule(SCOPE_POD, (R.Condition("namespace", selector({"t": "p"})),), api_hide=True),
        R.FilterRule(SCOPE_IMAGE, (R.Condition("namespace", selector({"t": "p"})),), ui_hide=True),
        R.FilterRule(SCOPE_IMAGE, (R.Condition("namespace", selector()),), deny=True, deny_message="no"),
    ]
    targets = [
        ("k1", "a", SCOPE_IMAGE, {}, {"t": "p"}, None, None),
        ("k1", "b", SCOPE_IMAGE, {}, {}, None, None),
        ("k1", "c", SCOPE_IMAGE, {}, None, None, None),
    ]
    expected = [
        ("k1", "a", SCOPE_IMAGE, True, False, False, None),
        ("k1", "b", SCOPE_IMAGE, False, False, True, "no"),
        ("k1", "c", SCOPE_IMAGE, False, False, False, None),
    ]
    for stored in (False, True):
        assert effects(spark, rules, targets, stored) == expected


def test_both_forms_agree_on_random_rules(spark):
    rng = random.Random(7)

    def labels():
        return rng.choice([None, {}, {k: rng.choice("ab") for k in rng.sample("xyz", rng.randint(1, 3))}])

    def requirement():
        op = rng.choice(["In", "NotIn", "Exists", "DoesNotExist", "Near"])
        values = tuple(rng.sample("abc", rng.randint(0, 2))) if op in ("In", "NotIn") else ()
        return L.Requirement(rng.choice("xyz"), op, values)

    def rule():
        conditions = tuple(
            R.Condition(
                rng.choice(R.SOURCES),
                L.Selector(
                    {rng.choice("xyz"): rng.choice("ab")} if rng.random() < 0.4 else {},
                    tuple(requirement() for _ in range(rng.randint(0, 2))),
                ),
            )
            for _ in range(rng.randint(0, 3))
        )
        deny = rng.random() < 0.5
        return R.FilterRule(
            rng.choice([SCOPE_KIND, SCOPE_IMAGE, SCOPE_POD]),
            conditions,
            rng.random() < 0.5,
            rng.random() < 0.5,
            deny,
            "m" if deny else None,
            rng.choice([None, None, ("k1",), ("k2",)]),
        )

    rules = [rule() for _ in range(60)]
    targets = [
        (rng.choice(["k1", "k2"]), f"t{i}", scope, labels(), labels(), labels(), labels())
        for i in range(150)
        for scope in [rng.choice([SCOPE_KIND, SCOPE_IMAGE, SCOPE_POD])]
    ]
    case = effects(spark, rules, targets)
    assert case == effects(spark, rules, targets, stored=True)
    assert len({row[3:] for row in case}) > 3


def test_hundreds_of_rules_repeated_rows_and_null_values(spark):
    """First of 600 rules a kind; a repeated rule row counts once, a null label or wanted value equals nothing."""
    rules = [R.FilterRule(SCOPE_POD, (R.Condition("pod", selector({"n": f"v{i % 300}"}, need("m", "NotIn", f"w{i}"))),), deny=True, deny_message=str(i)) for i in range(600)]
    targets = [
        ("k1", "a", SCOPE_POD, {"n": "v7"}, None, None, None),
        ("k1", "b", SCOPE_POD, {"n": "v7", "m": "w7"}, None, None, None),
        ("k1", "c", SCOPE_POD, {"n": None, "m": "w7"}, None, None, None),
        ("k1", "d", SCOPE_POD, {"": "x", "n": "v299", "m": None}, {}, {}, {}),
        (None, "e", SCOPE_POD, {"n": "v7"}, None, None, None),
        ("k2", "f", SCOPE_POD, None, None, None, {"n": "v7"}),
    ]
    table = R.filter_rule_table(spark.createDataFrame([("k1",), ("k1",)], "name string"), rules)
    nulls = table.filter("rule_idx = 0").withColumn("rule_idx", F.lit(-1)).withColumn(
        "conditions", F.transform("conditions", lambda c: c.withField("match_labels", F.create_map(F.lit("n"), F.lit(None).cast("string"))))
    )
    df = spark.createDataFrame(targets, TARGETS)
    out = R.evaluate_filter_rules(df, table.unionByName(nulls))
    assert rows(out, "id", "deny_message") == [("a", "7"), ("b", "307"), ("c", None), ("d", "299"), ("e", None), ("f", None)]
    assert R.evaluate_filter_rules(df, table.filter("false")).filter("deny").count() == 0
    assert R.evaluate_filter_rules(df.filter("false"), table).count() == 0


def activity(spark, rules, pods=None, namespaces=None, stored=False, kinds=("k",)):
    workspaces = spark.createDataFrame(
        [("n1", "w1", "k", "p1"), ("n2", "w2", "k", "p2"), ("gone", "w3", "k", "gone")],
        "namespace string, name string, kind string, pod_id string",
    )
    options = spark.createDataFrame(
        [("k", "pod", "p1", [("gpu", "1")]), ("k", "pod", "p2", [])],
        "kind string, option_type string, id string, labels array<struct<key:string,value:string>>",
    )
    spaces = spark.createDataFrame([("n1", {"tier": "dev"}), ("n2", {})], "name string, labels map<string,string>")
    used = rules
    if stored:
        used = R.activity_rule_table(spark.createDataFrame([(k,) for k in kinds], "name string"), rules)
    out = R.evaluate_activity_rules(workspaces, options, spaces, used)
    return rows(out, "name", "status", "rule_idx", "pause", "seconds_since_active", "min_running_seconds")


@pytest.mark.parametrize("stored", [False, True])
def test_activity_rules(spark, stored):
    gpu = R.Condition("pod", selector(None, need("gpu", "Exists")))
    not_dev = R.Condition("namespace", selector(None, need("tier", "NotIn", "dev")))
    bad = R.Condition("pod", selector(None, need("gpu", "Near", "1")))
    dev = R.Condition("namespace", selector({"tier": "dev"}))
    # a rule without the effect falls through; a matched false exempts; missing labels count as empty
    got = activity(spark, [R.ActivityRule(), R.ActivityRule((gpu,), False), R.ActivityRule((not_dev,), True, 60, 5)], stored=stored)
    assert got == [
        ("w1", "matched", 1, False, 0, 0),
        ("w2", "matched", 2, True, 60, 5),
        ("w3", "matched", 2, True, 60, 5),
    ]
    # an invalid selector is an error only where it is reached: after a match it is not, nor after a failed condition
    got = activity(spark, [R.ActivityRule((gpu,), False), R.ActivityRule((dev, bad), True, 1)], stored=stored)
    assert [row[1] for row in got] == ["matched", "none", "none"]
    got = activity(spark, [R.ActivityRule((dev, bad), True, 1), R.ActivityRule((), True, 9)], stored=stored)
    assert [row[1:3] for row in got] == [("error", 0), ("matched", 1), ("matched", 1)]


def test_pause_decision_boundaries(spark):
    exempt = R.Condition("namespace", selector({"tier": "production"}))
    rules = [R.ActivityRule((exempt,), False), R.ActivityRule((), True, 3600, 300)]
    data = [
        ("p", "w1", 1, 1),
        ("q", "w2", 6_400_000, 1_000_000),
        ("q", "w3", 6_400_001, 1_000_000),
        ("q", "w4", 1_000_000, 9_800_000),
        ("q", "w5", 0, 1_000_000),
        ("q", "w6", 1_000_000, 0),
    ]
    workspaces = spark.createDataFrame(
        [(ns, w, "k", "x", "Running", True, a, r) for ns, w, a, r in data],
        "namespace string, name string, kind string, pod_id string, state string, has_probe boolean, "
        "last_activity_ms bigint, last_running_ms bigint",
    )
    options = spark.createDataFrame(
        [], "kind string, option_type string, id string, labels array<struct<key:string,value:string>>"
    )
    spaces = spark.createDataFrame([("p", {"tier": "production"}), ("q", {})], "name string, labels map<string,string>")
    decided = R.evaluate_activity_rules(workspaces, options, spaces, rules)
    got = rows(R.pause_decision(decided, 10_000_000, F.lit(True)), "name", "eligible_after_ms", "eligible", "pause_now")
    assert got == [
        ("w1", None, False, False),
        ("w2", 10_000_000, True, True),
        ("w3", 10_000_001, False, False),
        ("w4", 4_600_000, False, False),
        ("w5", 0, False, False),
        ("w6", 4_600_000, False, False),
    ]
    stale = R.pause_decision(decided, 10_000_000, F.lit(False)).filter("pause_now").count()
    assert stale == 0
