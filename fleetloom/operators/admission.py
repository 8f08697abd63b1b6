"""Admission decisions for batches of change requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.constants import SCOPE_IMAGE, SCOPE_KIND, SCOPE_POD
from fleetloom.functions.columns import revision
from fleetloom.operators.report import report, violation
from fleetloom.operators.rules import evaluate_filter_rules, with_context

def _found(condition: Column, field: str, code: str, message: Column) -> Column:
    return violation(condition, field=field, code=code, message=message)


def _option_text(option_type: str, option_id: Column, tail: str, detail: Column | None = None) -> Column:
    text = F.concat(F.lit(f'not allowed: {option_type} config option "'), option_id, F.lit(f'" {tail}'))
    if detail is None:
        return text
    return F.when(F.coalesce(detail, F.lit("")) != "", F.concat(text, F.lit(": "), detail)).otherwise(text)


def _with_effects(requests: DataFrame, options: DataFrame, namespaces: DataFrame, rules) -> DataFrame:
    """Per request the effects of the first matching rule in each scope, as columns on the request row."""
    known_ns = namespaces.select(F.col("name").alias("namespace"), F.lit(True).alias("ns_known"))
    rows = with_context(requests, options, namespaces).join(known_ns, "namespace", "left")
    none = F.lit(None).cast("map<string,string>")
    for scope, labels, prefix in (
        (SCOPE_KIND, none, "kind"),
        (SCOPE_IMAGE, F.col("image_labels"), "image"),
        (SCOPE_POD, F.col("pod_labels"), "pod"),
    ):
        targets = rows.withColumn("scope", F.lit(scope)).withColumn("target_labels", labels)
        rows = (
            evaluate_filter_rules(targets, rules)
            .withColumnsRenamed({"api_hide": f"{prefix}_hide", "deny": f"{prefix}_deny", "deny_message": f"{prefix}_text"})
            .drop("ui_hide", "scope", "target_labels")
        )
    return rows.withColumn("ns_known", F.coalesce("ns_known", F.lit(False)))


def _kind_message(mutation: str, tail: str, detail: Column | None = None) -> Column:
    text = F.concat(F.lit(f'workspace {mutation} not allowed: workspace kind "'), F.col("kind"), F.lit(f'" {tail}'))
    if detail is None:
        return text
    return F.when(F.coalesce(detail, F.lit("")) != "", F.concat(text, F.lit(": "), detail)).otherwise(text)


def _rule_violations(mutation: str, checked: Column, image_checked: Column, pod_checked: Column) -> list[Column]:
    """Kind effects stop the check (hidden wins, so a deny text never leaks); option effects can all appear."""
    kind_hide, kind_deny = checked & F.col("kind_hide"), checked & ~F.col("kind_hide") & F.col("kind_deny")
    found = [
        _found(kind_hide, "kind", "Forbidden", _kind_message(mutation, "is hidden")),
        _found(kind_deny, "kind", "Forbidden", _kind_message(mutation, "is restricted", F.col("kind_text"))),
    ]
    allowed = checked & ~F.col("kind_hide") & ~F.col("kind_deny")
    for prefix, asked in (("image", image_checked), ("pod", pod_checked)):
        known = allowed & asked & F.col(f"{prefix}_labels").isNotNull()
        option_id, detail = F.col(f"{prefix}_id"), F.col(f"{prefix}_text")
        hidden = _option_text(prefix, option_id, "is hidden")
        restricted = _option_text(prefix, option_id, "is restricted", detail)
        found.append(_found(known & F.col(f"{prefix}_hide"), prefix, "Forbidden", hidden))
        found.append(_found(known & F.col(f"{prefix}_deny"), prefix, "Forbidden", restricted))
    return found


def _named(what: str, name: Column) -> Column:
    return F.concat(F.lit(f'{what} "'), name, F.lit('" not found'))


def admit_create(
    requests: DataFrame, kinds: DataFrame, options: DataFrame, namespaces: DataFrame, rules
) -> DataFrame:
    """Violations of create requests as (request_id, field, code, message); none means admitted.

    Unknown option ids are skipped here; the audits report them.
    """
    known = kinds.select(F.col("name").alias("kind"), F.lit(True).alias("kind_known"))
    rows = _with_effects(requests.join(known, "kind", "left"), options, namespaces, rules)
    no_kind = F.col("kind_known").isNull()
    no_namespace = ~no_kind & ~F.col("ns_known")
    checked = ~no_kind & F.col("ns_known")
    return report(
        rows,
        ["request_id"],
        [
            _found(no_kind, "kind", "Invalid", _named("workspace kind", F.col("kind"))),
            _found(no_namespace, "namespace", "Invalid", _named("namespace", F.col("namespace"))),
            *_rule_violations("create", checked, F.lit(True), F.lit(True)),
        ],
    )


def admit_update(
    requests: DataFrame, workspaces: DataFrame, kinds: DataFrame, options: DataFrame, namespaces: DataFrame, rules
) -> DataFrame:
    """Violations of update requests: stale revision first, kind rules always, option rules only when changed."""
    current = workspaces.select(
        "namespace",
        "name",
        "kind",
        F.col("image_id").alias("current_image"),
        F.col("pod_id").alias("current_pod"),
        revision(F.col("uid"), F.col("name"), F.col("generation")).alias("current_revision"),
    )
    known = kinds.select(F.col("name").alias("kind"), F.lit(True).alias("kind_known"))
    # the kind of a workspace is fixed: the request's own kind is not read
    joined = requests.drop("kind").join(current, ["namespace", "name"], "left").join(known, "kind", "left")
    rows = _with_effects(joined, options, namespaces, rules)
    missing = F.col("current_revision").isNull()
    stale = ~missing & (F.col("revision") != F.col("current_revision"))
    fresh = ~missing & (F.col("revision") == F.col("current_revision"))
    no_kind = fresh & F.col("kind_known").isNull()
    no_namespace = fresh & ~no_kind & ~F.col("ns_known")
    checked = fresh & ~no_kind & F.col("ns_known")
    return report(
        rows,
        ["request_id"],
        [
            _found(missing, "name", "NotFound", F.lit("workspace not found")),
            _found(stale, "revision", "Conflict", F.lit("workspace revision is stale")),
            _found(no_kind, "kind", "Internal", _named("workspace kind", F.col("kind"))),
            _found(no_namespace, "namespace", "Invalid", _named("namespace", F.col("namespace"))),
            *_rule_violations(
                "update",
                checked,
                F.col("image_id") != F.col("current_image"),
                F.col("pod_id") != F.col("current_pod"),
            ),
        ],
    )


def revision_conflicts(requests: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Requests whose revision no longer matches the stored object."""
    current = workspaces.select(
        "namespace", "name", revision(F.col("uid"), F.col("name"), F.col("generation")).alias("current_revision")
    )
    return requests.join(current, ["namespace", "name"]).filter(F.col("revision") != F.col("current_revision"))


def apply_pause_requests(workspaces: DataFrame, requests: DataFrame) -> DataFrame:
    """Accept or reject pause and start requests.

    Pausing needs a workspace that is not paused; starting needs a paused one whose state is Paused.
    """
    current = workspaces.select("namespace", "name", "paused", "state")
    wanted = requests.filter(F.col("op").isin("pause", "start")).select("request_id", "op", "namespace", "name")
    joined = wanted.join(current, ["namespace", "name"], "left")
    outcome = (
        F.when(F.col("paused").isNull(), F.lit("NotFound"))
        .when((F.col("op") == "pause") & F.col("paused"), F.lit("InvalidState"))
        .when((F.col("op") == "start") & ~F.col("paused"), F.lit("InvalidState"))
        .when((F.col("op") == "start") & (F.col("state") != "Paused"), F.lit("InvalidState"))
        .otherwise(F.lit("Accepted"))
    )
    return joined.withColumn("outcome", outcome)


def paused_snapshot(workspaces: DataFrame, decided: DataFrame) -> DataFrame:
    """Workspaces after the accepted requests of :func:`apply_pause_requests`; unchanged rows stay.

    When both kinds of request were accepted for one workspace the last request id wins.
    """
    accepted = (
        decided.filter(F.col("outcome") == "Accepted")
        .groupBy("namespace", "name")
        .agg(F.max_by(F.col("op") == "pause", "request_id").alias("new_paused"))
    )
    return (
        workspaces.join(accepted, ["namespace", "name"], "left")
        .withColumn("paused", F.coalesce("new_paused", "paused"))
        .drop("new_paused")
    )
