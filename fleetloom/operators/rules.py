"""Ordered first-match label rules.

A rule set known while the plan is built becomes a ``CASE`` chain (first match by definition, no shuffle). Rules
held in a table are turned into an inverted index: what each rule needs is posted under (kind, scope, source, key,
value) and joined to the labels of the distinct contexts. A rule matches where everything it needs was found and
nothing that it forbids, so a context meets only the rules that ask about its labels, however many there are. Both
forms give the same result, and neither runs a job while the plan is built.

A label map may be absent (null). Filter rules never match an absent map; activity rules read it as empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.constants import SCOPE_IMAGE, SCOPE_KIND, SCOPE_POD
from fleetloom.functions.columns import join_null_safe
from fleetloom.functions.labels import (
    Requirement,
    Selector,
    empty_labels,
    is_label_key,
    is_label_value,
    labels_map,
    selector_matches,
    stored_selector_valid,
)
from fleetloom.operators.report import violation

SOURCES = ("namespace", "image", "pod")

# What an activity decision depends on.
CONTEXT = ["kind", "namespace", "pod_id"]


@dataclass(frozen=True)
class Condition:
    """A selector on the labels of the namespace, the image option or the pod option."""

    source: str
    selector: Selector


@dataclass(frozen=True)
class FilterRule:
    scope: str
    conditions: tuple[Condition, ...]
    ui_hide: bool = False
    api_hide: bool = False
    deny: bool = False
    deny_message: str | None = None
    kinds: tuple[str, ...] | None = None


@dataclass(frozen=True)
class ActivityRule:
    """``pause`` None means the rule does not configure the pause effect."""

    conditions: tuple[Condition, ...] = ()
    pause: bool | None = None
    seconds_since_active: int = 0
    min_running_seconds: int | None = None
    kinds: tuple[str, ...] | None = None


def _requirement_valid(requirement: Requirement) -> bool:
    if requirement.op in ("In", "NotIn"):
        return len(requirement.values) > 0
    return requirement.op in ("Exists", "DoesNotExist") and not requirement.values


def _selector_valid(selector: Selector) -> bool:
    """The same rule as for selectors held in columns: arity, and the syntax of keys and values."""
    keys = [*selector.match_labels, *(requirement.key for requirement in selector.match_exprs)]
    values = [*selector.match_labels.values(), *(v for requirement in selector.match_exprs for v in requirement.values)]
    return (
        all(_requirement_valid(requirement) for requirement in selector.match_exprs)
        and all(is_label_key(key) for key in keys)
        and all(is_label_value(value) for value in values)
    )


# --- rules as tables -------------------------------------------------------------------------------------------


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def _conditions_literal(conditions: tuple[Condition, ...]) -> Column:
    def requirement(r: Requirement) -> Column:
        values = F.array(*[F.lit(value) for value in r.values]).cast("array<string>")
        return F.struct(_text(r.key).alias("key"), _text(r.op).alias("op"), values.alias("values"))

    def condition(c: Condition) -> Column:
        pairs = [F.lit(part) for pair in c.selector.match_labels.items() for part in pair]
        exprs = F.array(*[requirement(r) for r in c.selector.match_exprs])
        return F.struct(
            _text(c.source).alias("source"),
            (F.create_map(*pairs) if pairs else empty_labels()).alias("match_labels"),
            exprs.cast("array<struct<key:string,op:string,values:array<string>>>").alias("match_exprs"),
        )

    return F.array(*[condition(c) for c in conditions]).cast(
        "array<struct<source:string,match_labels:map<string,string>,"
        "match_exprs:array<struct<key:string,op:string,values:array<string>>>>>"
    )


def _kinds_literal(kinds: tuple[str, ...] | None) -> Column:
    return F.lit(None).cast("array<string>") if kinds is None else F.array(*[F.lit(kind) for kind in kinds])


def _rule_rows(kinds: DataFrame, literals: list[Column]) -> DataFrame:
    rows = kinds.select(F.col("name").alias("kind"), F.posexplode(F.array(*literals)).alias("rule_idx", "r"))
    applies = F.col("r.only").isNull() | F.array_contains("r.only", F.col("kind"))
    return rows.filter(applies).select("kind", "rule_idx", "r.*").drop("only")


def filter_rule_table(kinds: DataFrame, rules: list[FilterRule]) -> DataFrame:
    """One row per kind and rule."""
    return _rule_rows(
        kinds,
        [
            F.struct(
                _text(rule.scope).alias("scope"),
                F.lit(rule.ui_hide).alias("ui_hide"),
                F.lit(rule.api_hide).alias("api_hide"),
                F.lit(rule.deny).alias("deny"),
                _text(rule.deny_message).alias("deny_message"),
                _conditions_literal(rule.conditions).alias("conditions"),
                _kinds_literal(rule.kinds).alias("only"),
            )
            for rule in rules
        ],
    )


def activity_rule_table(kinds: DataFrame, rules: list[ActivityRule]) -> DataFrame:
    return _rule_rows(
        kinds,
        [
            F.struct(
                F.lit(rule.seconds_since_active).alias("seconds_since_active"),
                F.lit(rule.min_running_seconds).cast("int").alias("min_running_seconds"),
                F.lit(rule.pause).cast("boolean").alias("pause"),
                _conditions_literal(rule.conditions).alias("conditions"),
                _kinds_literal(rule.kinds).alias("only"),
            )
            for rule in rules
        ],
    )


# --- the index -------------------------------------------------------------------------------------------------

_NEED = "struct<source:string,key:string,values:array<string>,forbids:boolean>"


def _need(source: Column, key: Column, values: Column, forbids: bool) -> Column:
    """Something asked of a label: one of ``values``, or (null) any value; ``forbids`` turns it round."""
    return F.struct(
        source.alias("source"), key.alias("key"), values.alias("values"), F.lit(forbids).alias("forbids")
    ).cast(_NEED)


def _needs_of(condition: Column) -> Column:
    """What a valid condition needs; one that asks for no label needs the map itself, posted under an empty key."""
    source = F.when(condition["source"].isin("namespace", "image"), condition["source"]).otherwise(F.lit("pod"))
    any_value = F.lit(None).cast("array<string>")
    nothing = F.array().cast(f"array<{_NEED}>")
    exact = F.transform(
        F.map_entries(condition["match_labels"]),
        lambda e: _need(source, e["key"], F.array_compact(F.array(e["value"])), False),
    )
    listed = lambda r: F.array_distinct(F.array_compact(r["values"]))
    asked = F.transform(
        condition["match_exprs"],
        lambda r: F.when(r["op"] == "In", _need(source, r["key"], listed(r), False))
        .when(r["op"] == "Exists", _need(source, r["key"], any_value, False))
        .when(r["op"] == "NotIn", _need(source, r["key"], listed(r), True))
        .otherwise(_need(source, r["key"], any_value, True)),
    )
    needs = F.concat(F.coalesce(exact, nothing), F.coalesce(asked, nothing))
    the_map = F.array(_need(source, F.lit(""), any_value, False))
    return F.when(F.exists(needs, lambda n: ~n["forbids"]), needs).otherwise(F.concat(needs, the_map))


def _labels_seen(maps: dict[str, Column]) -> Column:
    """(source, key, value) of every label, of every map that is there (empty key), and one entry that is always there."""
    kind = "array<struct<source:string,key:string,value:string>>"

    def of(source: str, labels: Column) -> Column:
        entry = lambda key, value: F.struct(F.lit(source).alias("source"), key.alias("key"), value.alias("value"))
        named = F.filter(F.map_entries(labels), lambda e: e["key"] != "")
        there = F.array(entry(F.lit(""), _text(None)))
        seen = F.concat(there, F.transform(named, lambda e: entry(e["key"], e["value"])))
        return F.when(labels.isNotNull(), seen.cast(kind)).otherwise(F.array().cast(kind))

    always = F.array(F.struct(F.lit("").alias("source"), F.lit("").alias("key"), _text(None).alias("value"))).cast(kind)
    return F.concat(always, *[of(source, labels) for source, labels in maps.items()])


def _postings(rules: DataFrame, group: list[str], answer: list[str]) -> DataFrame:
    """One row per value that a rule needs or forbids, with the number of its needs; a rule without any needs always."""
    always = F.array(_need(F.lit(""), F.lit(""), F.lit(None).cast("array<string>"), False))
    needs = F.flatten(F.transform("conditions", _needs_of))
    needs = F.when(F.coalesce(F.size("conditions"), F.lit(0)) > 0, needs).otherwise(always)
    one_each = rules.select(*group, F.struct("rule_idx", *answer).alias("rule"), needs.alias("needs")).distinct()
    rows = one_each.select(
        *group, "rule", F.size(F.filter("needs", lambda n: ~n["forbids"])).alias("needed"), F.explode("needs").alias("n")
    )
    values = F.coalesce("n.values", F.array(_text(None)))
    return rows.select(*group, "rule", "needed", "n.source", "n.key", "n.forbids", F.explode(values).alias("value"))


def first_matching(
    targets: DataFrame, rules: DataFrame, group: list[str], maps: dict[str, Column], answer: list[str]
) -> DataFrame:
    """``targets`` with ``hit``: rule_idx and the columns ``answer`` of the first rule of its group that matches, or null.

    ``rules`` holds the columns of ``group``, rule_idx (unique in its kind; repeated rows count once), valid
    ``conditions`` and ``answer``. Equal labels in equal groups are judged once, as far as any
    rule of the group asks for them. A null in a group's columns has no rules.
    """
    posted = _postings(rules.dropna(subset=group), group, answer)
    # of a label that no rule of the group asks for nothing depends: one array of its rules' keys for each group
    keys = posted.groupBy(*group).agg(F.collect_set(F.concat("source", F.lit(":"), "key")).alias("_keys"))
    told = {source: f"labels_{source}" for source in maps}

    def asked_of(source: str, labels: Column) -> Column:
        return F.map_filter(labels.cast("map<string,string>"), lambda k, _v: F.array_contains("_keys", F.concat(F.lit(f"{source}:"), k)))

    # a text that can be read back; equal maps written in another order only make another context
    context = F.struct(*group, *[asked_of(source, labels).alias(told[source]) for source, labels in maps.items()])
    known = targets.join(keys, group, "left").withColumn("_context", F.to_json(context)).select(*targets.columns, "_context")
    schema = ", ".join([*(f"{c} string" for c in group), *(f"{column} map<string,string>" for column in told.values())])
    contexts = (
        known.select("_context")
        .distinct()
        .select("_context", F.from_json("_context", schema).alias("c"))
        .select("_context", "c.*")
        .withColumn("_seen", _labels_seen({source: F.col(column) for source, column in told.items()}))
    )
    # every label is looked up with its value and, for rules that take any, without
    plain = F.transform("_seen", lambda s: s.withField("value", _text(None)))
    looked_up = F.concat(plain, F.filter("_seen", lambda s: s["value"].isNotNull()))
    asked = contexts.select("_context", *group, F.explode(looked_up).alias("s")).select("_context", *group, "s.*")
    found = (
        join_null_safe(asked, posted, [*group, "source", "key", "value"], "inner")
        .groupBy("_context", "rule", "needed")
        .agg(F.count_if(~F.col("forbids")).alias("met"), F.bool_or("forbids").alias("broken"))
        .filter((F.col("met") == F.col("needed")) & ~F.col("broken"))
        .groupBy("_context")
        .agg(F.min("rule").alias("hit"))
    )
    return known.join(found, "_context", "left").drop("_context")


# --- filter rules ----------------------------------------------------------------------------------------------


def workspace_targets(workspaces: DataFrame, options: DataFrame, namespaces: DataFrame) -> DataFrame:
    """What the rules are asked about: the kind and both selected options of every workspace.

    Columns: namespace, name, kind, scope, target_id, target_labels and the three context maps.
    """
    context = with_context(workspaces.select("namespace", "name", "kind", "image_id", "pod_id"), options, namespaces)
    targets = F.array(
        _target(SCOPE_KIND, F.col("kind"), F.lit(None).cast("map<string,string>")),
        _target(SCOPE_IMAGE, F.col("image_id"), F.col("image_labels")),
        _target(SCOPE_POD, F.col("pod_id"), F.col("pod_labels")),
    )
    return (
        context.withColumn("t", F.explode(targets))
        .select("namespace", "name", "kind", "t.*", "namespace_labels", "image_labels", "pod_labels")
        .filter((F.col("scope") == SCOPE_KIND) | F.col("target_labels").isNotNull())
    )


def _target(scope: str, target_id: Column, labels: Column) -> Column:
    return F.struct(F.lit(scope).alias("scope"), target_id.alias("target_id"), labels.alias("target_labels"))


def with_context(df: DataFrame, options: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Add namespace_labels, image_labels and pod_labels; unknown ids and namespaces stay null."""
    known = options.select("kind", "option_type", "id", labels_map(F.col("labels")).alias("labels"))
    for option_type in ("image", "pod"):
        part = known.filter(F.col("option_type") == option_type).select(
            "kind", F.col("id").alias(f"{option_type}_id"), F.col("labels").alias(f"{option_type}_labels")
        )
        df = df.join(part, ["kind", f"{option_type}_id"], "left")
    labels = namespaces.select(F.col("name").alias("namespace"), F.col("labels").alias("namespace_labels"))
    return df.join(labels, "namespace", "left")


def source_maps(df: DataFrame) -> dict[str, Column]:
    """Condition source to label map; an option reads its own labels in its own scope."""
    column = {name: F.col(name) for name in ("namespace_labels", "image_labels", "pod_labels", "target_labels")}
    scope = F.col("scope")
    return {
        "namespace": column["namespace_labels"],
        "image": F.when(scope == SCOPE_IMAGE, column["target_labels"]).otherwise(column["image_labels"]),
        "pod": F.when(scope == SCOPE_POD, column["target_labels"]).otherwise(column["pod_labels"]),
    }


def _effect(ui_hide: Column, api_hide: Column, deny: Column, message: Column) -> Column:
    return F.struct(
        F.coalesce(ui_hide, F.lit(False)).alias("ui_hide"),
        F.coalesce(api_hide, F.lit(False)).alias("api_hide"),
        F.coalesce(deny, F.lit(False)).alias("deny"),
        F.when(F.coalesce(deny, F.lit(False)), message).alias("deny_message"),
    )


def _no_effect() -> Column:
    return _effect(F.lit(False), F.lit(False), F.lit(False), _text(None))


def _filter_case(targets: DataFrame, rules: list[FilterRule]) -> DataFrame:
    maps = source_maps(targets)
    chain = None
    for rule in rules:
        conditions = [c for c in rule.conditions if _selector_valid(c.selector)]
        if not conditions:
            continue
        matched = F.col("scope") == rule.scope
        if rule.kinds is not None:
            matched = matched & F.col("kind").isin(list(rule.kinds))
        for condition in conditions:
            labels = maps[condition.source]
            matched = matched & labels.isNotNull() & selector_matches(labels, condition.selector)
        effect = _effect(F.lit(rule.ui_hide), F.lit(rule.api_hide), F.lit(rule.deny), _text(rule.deny_message))
        chain = F.when(matched, effect) if chain is None else chain.when(matched, effect)
    outcome = _no_effect() if chain is None else chain.otherwise(_no_effect())
    return targets.withColumn("effect", outcome)


def usable_filter_rules(rules: DataFrame) -> DataFrame:
    """Drop invalid conditions, then rules left with none (they never fire)."""
    valid = F.filter("conditions", lambda c: stored_selector_valid(c["match_labels"], c["match_exprs"]))
    return rules.withColumn("conditions", valid).filter(F.size("conditions") > 0)


def _filter_index(targets: DataFrame, rules: DataFrame) -> DataFrame:
    answer = ["ui_hide", "api_hide", "deny", "deny_message"]
    judged = first_matching(targets, usable_filter_rules(rules), ["kind", "scope"], source_maps(targets), answer)
    effect = _effect(F.col("hit.ui_hide"), F.col("hit.api_hide"), F.col("hit.deny"), F.col("hit.deny_message"))
    return judged.withColumn("effect", effect).drop("hit")


def evaluate_filter_rules(targets: DataFrame, rules: list[FilterRule] | DataFrame) -> DataFrame:
    """First matching rule per target; adds ui_hide, api_hide, deny, deny_message (all false without a match).

    ``targets`` holds kind, scope, target_labels, namespace_labels, image_labels and pod_labels.
    """
    result = _filter_case(targets, rules) if isinstance(rules, list) else _filter_index(targets, rules)
    # the effect columns are read several times below; selecting them once keeps the plan small
    return result.select("*", "effect.*").drop("effect")


def visible_kinds(kinds: DataFrame, rules, contexts: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Kinds as seen from each context (kind, namespace); a context without a namespace hides nothing."""
    none = F.lit(None).cast("map<string,string>")
    labels = namespaces.select(F.col("name").alias("namespace"), F.col("labels").alias("namespace_labels"))
    targets = (
        contexts.select("kind", "namespace")
        .join(kinds.select(F.col("name").alias("kind"), "display_name", "hidden", "deprecated"), "kind")
        .join(labels, "namespace", "left")
        .select(
            "*",
            F.lit(SCOPE_KIND).alias("scope"),
            none.alias("target_labels"),
            none.alias("image_labels"),
            none.alias("pod_labels"),
        )
    )
    seen = evaluate_filter_rules(targets, rules).filter(~F.col("api_hide"))
    return seen.select(
        "kind",
        "namespace",
        "display_name",
        F.coalesce("deprecated", F.lit(False)).alias("deprecated"),
        (F.coalesce("hidden", F.lit(False)) | F.col("ui_hide")).alias("hidden"),
        "deny",
        "deny_message",
    )


def list_option_values(
    contexts: DataFrame, options: DataFrame, namespaces: DataFrame, rules, usage: DataFrame
) -> DataFrame:
    """Options offered in each context (context_id, kind, namespace, image_id, pod_id).

    A selected id restricts its list to that option; an unknown id gives an error row; hidden-by-rule options are
    left out. Contexts with a selection join on the full option key, so only open ones list a whole kind.
    """
    asked = F.array(
        *[
            F.struct(
                F.lit(option_type).alias("option_type"),
                F.lit(scope).alias("scope"),
                F.col(f"{option_type}_id").alias("target_id"),
            )
            for option_type, scope in (("image", SCOPE_IMAGE), ("pod", SCOPE_POD))
        ]
    )
    rows = with_context(contexts, options, namespaces).select("*", F.explode(asked).alias("asked")).select(
        "*", "asked.*"
    )
    known = options.select(
        "kind", "option_type", F.col("id").alias("target_id"), "display_name", "hidden", "labels"
    )
    selected = rows.filter(F.col("target_id").isNotNull()).join(known, ["kind", "option_type", "target_id"], "left")
    whole = rows.filter(F.col("target_id").isNull()).drop("target_id").join(known, ["kind", "option_type"])
    listed = selected.unionByName(whole)
    targets = listed.withColumn("found", F.col("labels").isNotNull()).withColumn(
        "target_labels", F.when(F.col("labels").isNotNull(), labels_map(F.col("labels")))
    )
    values = evaluate_filter_rules(targets, rules)
    counts = usage.select("kind", "option_type", F.col("id").alias("target_id"), "workspaces")
    found = F.col("found")
    message = F.format_string(
        "no %s option %s in kind %s",
        F.col("option_type"),
        F.col("target_id"),
        F.col("kind"),
    )
    return (
        values.filter(~found | ~F.col("api_hide"))
        .join(counts, ["kind", "option_type", "target_id"], "left")
        .select(
            "context_id",
            "kind",
            "option_type",
            F.col("target_id").alias("id"),
            "display_name",
            F.when(found, F.coalesce("hidden", F.lit(False)) | F.col("ui_hide")).alias("hidden"),
            F.when(found, F.col("deny")).alias("deny"),
            F.when(found, F.col("deny_message")).alias("deny_message"),
            F.when(found, F.coalesce("workspaces", F.lit(0).cast("bigint"))).alias("workspaces"),
            F.when(~found, message).alias("error"),
        )
    )


def contextual_default(defaults: DataFrame, all_options: DataFrame, context_options: DataFrame) -> DataFrame:
    """Keep a default unless it is missing from either list or became hidden only in the context.

    ``defaults`` holds context_id, kind, option_type, default_id.
    """
    configured = all_options.select(
        "kind",
        "option_type",
        F.col("id").alias("default_id"),
        F.coalesce("hidden", F.lit(False)).alias("all_hidden"),
    )
    offered = context_options.filter(F.col("error").isNull()).select(
        "context_id", "option_type", F.col("id").alias("default_id"), F.col("hidden").alias("ctx_hidden")
    )
    kept = F.col("all_hidden").isNotNull() & F.col("ctx_hidden").isNotNull() & (
        F.col("all_hidden") | ~F.col("ctx_hidden")
    )
    return (
        defaults.join(configured, ["kind", "option_type", "default_id"], "left")
        .join(offered, ["context_id", "option_type", "default_id"], "left")
        .select(
            "context_id", "kind", "option_type", "default_id", F.when(kept, F.col("default_id")).alias("resolved_id")
        )
    )


# --- activity rules --------------------------------------------------------------------------------------------


def _activity_struct(status: Column, idx: Column, pause: Column, seconds: Column, minimum: Column) -> Column:
    return F.struct(
        status.alias("status"),
        idx.cast("bigint").alias("rule_idx"),
        pause.cast("boolean").alias("pause"),
        seconds.cast("bigint").alias("seconds_since_active"),
        F.when(status == "matched", F.coalesce(minimum, F.lit(0))).cast("bigint").alias("min_running_seconds"),
    )


def _null() -> Column:
    return F.lit(None)


def _activity_case(workspaces: DataFrame, rules: list[ActivityRule]) -> DataFrame:
    maps = {"namespace": F.col("namespace_labels"), "pod": F.col("pod_labels")}
    chain = F
    for idx, rule in enumerate(rules):
        if rule.pause is None:
            continue
        reached = F.lit(True) if rule.kinds is None else F.col("kind").isin(list(rule.kinds))
        failed = False
        for condition in rule.conditions:
            if not _selector_valid(condition.selector):
                failed = True
                break
            reached = reached & selector_matches(maps[condition.source], condition.selector)
        if failed:
            outcome = _activity_struct(F.lit("error"), F.lit(idx), _null(), _null(), _null())
        else:
            outcome = _activity_struct(
                F.lit("matched"),
                F.lit(idx),
                F.lit(rule.pause),
                F.lit(rule.seconds_since_active),
                F.lit(rule.min_running_seconds),
            )
        chain = chain.when(reached, outcome)
    nothing = _activity_struct(F.lit("none"), _null(), _null(), _null(), _null())
    return workspaces.withColumn("decision", nothing if chain is F else chain.otherwise(nothing))


def _until_invalid(rules: DataFrame) -> DataFrame:
    """Rules of the pause effect with the conditions before the first invalid one, and ``failed``: is there one?

    Conditions are read in order and the first one not matching ends the rule, so an invalid one is reached exactly
    where all before it match.
    """
    valid = F.transform("conditions", lambda c: stored_selector_valid(c["match_labels"], c["match_exprs"]))
    first = F.coalesce(F.array_position(valid, F.lit(False)), F.lit(0))
    before = F.when(first > 0, F.slice("conditions", F.lit(1), (first - 1).cast("int"))).otherwise(F.col("conditions"))
    return rules.filter(F.col("pause").isNotNull()).withColumn("failed", first > 0).withColumn("conditions", before)


def _activity_index(contexts: DataFrame, rules: DataFrame) -> DataFrame:
    pod = F.col("pod_labels")
    maps = {"namespace": F.col("namespace_labels"), "image": pod, "pod": pod}
    answer = ["failed", "pause", "seconds_since_active", "min_running_seconds"]
    judged = first_matching(contexts, _until_invalid(rules), ["kind"], maps, answer)
    failed = F.col("hit.failed")
    status = F.when(failed.isNull(), F.lit("none")).when(failed, F.lit("error")).otherwise(F.lit("matched"))
    good = status == "matched"
    decision = _activity_struct(
        status,
        F.col("hit.rule_idx"),
        F.when(good, F.col("hit.pause")),
        F.when(good, F.col("hit.seconds_since_active")),
        F.col("hit.min_running_seconds"),
    )
    return judged.withColumn("decision", decision).drop("hit")


def evaluate_activity_rules(
    workspaces: DataFrame,
    options: DataFrame,
    namespaces: DataFrame,
    rules: list[ActivityRule] | DataFrame,
) -> DataFrame:
    """First rule that configures the pause effect and matches; adds status, rule_idx, pause and its settings.

    ``status`` is matched, none, or error (an invalid selector was reached before any match). A matched
    ``pause`` false ends the search: it exempts the workspace.
    """
    pods = options.filter(F.col("option_type") == "pod").select(
        "kind", F.col("id").alias("pod_id"), labels_map(F.col("labels")).alias("pod_labels")
    )
    labels = namespaces.select(F.col("name").alias("namespace"), F.col("labels").alias("namespace_labels"))

    def with_labels(df: DataFrame) -> DataFrame:
        joined = df.join(pods, ["kind", "pod_id"], "left").join(labels, "namespace", "left")
        return joined.withColumns(
            {column: F.coalesce(column, empty_labels()) for column in ("pod_labels", "namespace_labels")}
        )

    if isinstance(rules, list):
        decided = _activity_case(with_labels(workspaces), rules)
        return decided.select("*", "decision.*").drop("decision", "pod_labels", "namespace_labels")
    # rules in a table cost more per row, and the answer depends on kind, namespace and pod option only:
    # judge each combination once and join the answers back
    contexts = with_labels(workspaces.select(*CONTEXT).distinct())
    judged = _activity_index(contexts, rules)
    answers = judged.select(*[F.col(key).alias(f"_{key}") for key in CONTEXT], "decision.*")
    same = [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in CONTEXT]
    return workspaces.join(answers, reduce(Column.__and__, same)).drop(*[f"_{key}" for key in CONTEXT])


def pause_decision(decided: DataFrame, now_ms: int | Column, fresh_probe: Column) -> DataFrame:
    """Eligibility and pause of running workspaces of kinds with a probe.

    ``decided`` comes from :func:`evaluate_activity_rules` and also holds state, has_probe, last_activity_ms and
    last_running_ms. ``eligible_after_ms`` is null when no pausing rule applies and 0 when activity is unknown.
    """
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    activity, running = F.col("last_activity_ms"), F.col("last_running_ms")
    considered = F.col("has_probe") & (F.col("state") == "Running")
    pausing = considered & (F.col("status") == "matched") & F.col("pause")
    due = F.when(activity > 0, activity + F.col("seconds_since_active") * 1000).otherwise(F.lit(0))
    minimum = F.col("min_running_seconds")
    ran_enough = (minimum == 0) | ((running > 0) & (now - running >= minimum * 1000))
    eligible = pausing & (activity > 0) & (now >= due) & ran_enough
    return (
        decided.withColumn("eligible_after_ms", F.when(pausing, due))
        .withColumn("eligible", F.coalesce(eligible, F.lit(False)))
        .withColumn("pause_now", F.col("eligible") & F.coalesce(fresh_probe, F.lit(False)))
    )


# --- lint ------------------------------------------------------------------------------------------------------


def _bad_selector(condition: Column) -> Column:
    return ~stored_selector_valid(condition["match_labels"], condition["match_exprs"])


def lint_filter_rules(rules: DataFrame) -> DataFrame:
    """Violations of filter rules as (kind, rule_idx, field, message)."""
    has_effect = (
        F.coalesce("ui_hide", F.lit(False)) | F.coalesce("api_hide", F.lit(False)) | F.coalesce("deny", F.lit(False))
    )
    no_effect = violation(
        ~has_effect,
        field="effect",
        message="rule has no effect",
    )

    def condition_violations(c: Column, i: Column) -> Column:
        path = F.concat(F.lit("match["), i.cast("string"), F.lit("]"))
        misplaced = violation(
            (F.col("scope") == SCOPE_KIND) & c["source"].isin("image", "pod"),
            field=path,
            message=F.concat(c["source"], F.lit(" conditions are only valid in option scopes")),
        )
        return F.array(misplaced, violation(_bad_selector(c), field=path, message="invalid label selector"))

    found = F.concat(F.array(no_effect), F.flatten(F.transform("conditions", condition_violations)))
    return rules.select("kind", "rule_idx", F.explode(F.array_compact(found)).alias("v")).select(
        "kind", "rule_idx", "v.*"
    )


def lint_activity_rules(rules: DataFrame, kinds: DataFrame, default_interval_s: int) -> DataFrame:
    """Violations and warnings of activity rules as (kind, rule_idx, severity, message).

    Only per-kind minima and maxima are needed, so no window over a kind's rules is built.
    """
    empty = F.size("conditions") == 0
    effective = F.col("pause").isNotNull()
    per_kind = rules.filter(effective).groupBy("kind").agg(
        F.max("rule_idx").alias("last_effective"),
        F.min(F.when(empty, F.col("rule_idx"))).alias("first_catch_all"),
        F.min(F.when(F.col("pause"), F.col("rule_idx"))).alias("first_pause"),
    )
    probes = kinds.select(
        F.col("name").alias("kind"),
        F.col("probe").isNotNull().alias("has_probe"),
        F.coalesce(F.col("probe.interval_s"), F.lit(default_interval_s)).cast("bigint").alias("interval_s"),
    )
    judged = rules.join(per_kind, "kind", "left").join(probes, "kind")
    position = F.col("rule_idx")
    catch_all = effective & empty
    bad_selector = F.filter("conditions", _bad_selector)
    short = F.col("seconds_since_active").cast("bigint") < 2 * F.col("interval_s")
    found = [
        violation(
            catch_all & (position > F.col("first_catch_all")),
            severity="error",
            message="at most one catch-all rule is allowed",
        ),
        violation(
            catch_all & (position < F.col("last_effective")),
            severity="error",
            message="catch-all must be the last rule",
        ),
        violation(
            F.col("pause") & short,
            severity="warning",
            message="seconds since active is less than twice the probe interval",
        ),
        violation(
            ~F.col("has_probe") & (position == F.col("first_pause")),
            severity="error",
            message="an activity probe is required",
        ),
    ]
    selectors = F.transform(bad_selector, lambda c: violation(F.lit(True), severity="error", message="invalid label selector"))
    every = F.concat(F.array_compact(F.array(*found)), selectors)
    return judged.select("kind", "rule_idx", F.explode(every).alias("v")).select("kind", "rule_idx", "v.*")
